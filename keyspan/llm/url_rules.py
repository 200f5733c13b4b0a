"""URL rules by a sort-merge range join (operator 10), DataFrame functions only.

A rule is ``(host, path, verdict)``: it fits its host and all subdomains where the url's path starts with the rule's.
Hosts are written backwards, label by label (``org.example.www.``), so a rule's host and its subdomains are one
interval of sorted keys; so are the paths that start with a rule's, behind the host's key. Two such intervals are
disjoint or nested. A sweep over the sorted keys of rules and urls therefore keeps a stack: a rule is pushed at its key and
popped at the first key that does not start with it; what is on the stack at a url's key fits the url.

The sweep runs on blocks of sorted distinct keys; a block starts with the rules that the blocks before it left open, which
the same sweep finds among the ends of blocks. Hosts and paths are made distinct before, so a host with a third of all pages is
one key.

Defined cases: a url that is null or has no ``://`` has an empty host and path, and no rule. An empty path fits no
rule whose path is ``/``. Of several fitting rules the longest ``host + path`` wins, at a tie the longer host. Rules
repeated with both verdicts block. Rules with a null, or without a host, fit nothing. Without a fitting rule the
verdict is ``default``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.llm.staging import staged
from keyspan.operators.frames import quoted

DEFAULT = "allow"
# Stands behind the host in a key, below every character of a path.
BEHIND_HOST = "\x01"
# Sorted rows that are swept at once.
BLOCK_ROWS = 500
# Of equal keys the rule comes first: it fits the key itself.
RULE, ASKED = 0, 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """``www.example.org`` as ``org.example.www.``."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _nothing() -> Column:
    return F.expr("cast(array() as array<string>)")


def _swept(blocks: DataFrame) -> DataFrame:
    """``(key, open)`` of the asked keys of blocks ``(rows, carried)``: a sweep over the sorted rows with a stack of open rules."""
    answers = F.expr("cast(array() as array<struct<key: string, open: array<string>>>)")
    start = F.struct(F.coalesce("carried", _nothing()).alias("stack"), answers.alias("answers"))

    def step(state: Column, row: Column) -> Column:
        # What the key does not start with has ended, for this key and all behind it.
        still = F.filter(state["stack"], lambda rule: row["key"].startswith(rule))
        is_rule = row["kind"] == RULE
        answer = F.array(F.struct(row["key"].alias("key"), still.alias("open")))
        return F.struct(
            F.when(is_rule, F.array_union(still, F.array(row["key"]))).otherwise(still).alias("stack"),
            F.when(is_rule, state["answers"]).otherwise(F.concat(state["answers"], answer)).alias("answers"),
        )

    return blocks.select(F.inline(F.aggregate("rows", start, step)["answers"]))


_ORDER = "key", "kind"


def _sorted_rows() -> Column:
    return F.array_sort(F.collect_list(F.struct(*_ORDER))).alias("rows")


def _sweep(rows: DataFrame, size: int, ranges: int | None = None) -> DataFrame:
    """``(key, open)`` of the asked keys among distinct ``rows`` of ``(key, kind)``, swept in blocks of ``size`` sorted rows.

    What the blocks before leave open at the first key of a block is the same question with a row per block, and per rule that is
    open at the end of its own block. Once these fit one block it is answered; blocks double on the way up, so that even rules
    nested a block deep and ranges of few rows come to an end.
    """
    laid = (rows.repartitionByRange(ranges, *_ORDER) if ranges else rows.repartitionByRange(*_ORDER)).sortWithinPartitions(*_ORDER)
    # Numbered within its partition in the lower 33 bits.
    place = F.monotonically_increasing_id()
    number = laid.withColumn("place", place).select(*_ORDER, F.shiftright("place", 33).alias("part"), F.expr(f"(place & {2**33 - 1}) div {size}").alias("block"))
    blocks = staged(number.groupBy("part", "block").agg(_sorted_rows()).select("rows"))
    last = F.element_at("rows", -1)["key"]
    left_open = F.transform(F.filter("rows", lambda r: (r["kind"] == RULE) & last.startswith(r["key"])), lambda r: r["key"])
    n_blocks, n_rules = blocks.agg(F.count("*"), F.coalesce(F.sum(F.size(left_open)), F.lit(0))).first()
    if n_blocks < 2:
        return _swept(blocks.withColumn("carried", _nothing()))
    firsts = blocks.select(F.col("rows")[0]["key"].alias("key")).distinct().select("key", F.lit(ASKED).alias("kind"))
    above = blocks.select(F.explode(left_open).alias("key")).select("key", F.lit(RULE).alias("kind")).union(firsts)
    if n_blocks + n_rules <= 2 * size:
        carried = _swept(above.agg(_sorted_rows()).withColumn("carried", _nothing()))
    else:
        carried = _sweep(above, 2 * size, ranges=-(-n_blocks // size))
    carried = carried.select(F.col("key").alias("first"), F.col("open").alias("carried"))
    return _swept(blocks.join(carried, F.col("rows")[0]["key"] == F.col("first"), "left"))


def open_intervals(probes: DataFrame, keys: DataFrame, size: int = BLOCK_ROWS) -> DataFrame:
    """``(key, open)`` for each distinct ``key`` of ``probes``: the ``key`` values of ``keys`` that it starts with, shortest first."""
    rules = keys.select("key").distinct().select("key", F.lit(RULE).alias("kind"))
    return _sweep(rules.union(probes.select("key").distinct().select("key", F.lit(ASKED).alias("kind"))), size)


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``; ``rules`` has ``host, path, verdict``."""
    rules = (
        rules.where("host is not null and path is not null and verdict is not null and host != ''")
        .select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("host_key", host_key(F.col("rule_host")))
        .withColumn("rule_key", F.concat("host_key", F.lit(BEHIND_HOST), "rule_path"))
    )
    rows = pages.select(quoted(page_id).alias("page_id"), url_host(quoted(url)).alias("host"), url_path(quoted(url)).alias("path"))
    places = staged(rows.where("host != ''").groupBy("host", "path").count().select("host", "path", host_key(F.col("host")).alias("key")))
    hosts = open_intervals(places, rules.select(F.col("host_key").alias("key"))).where(F.size("open") > 0)
    # A place under each rule host above it, then the same sweep over the paths behind those hosts.
    under = staged(
        places.join(hosts, "key").select("host", "path", F.explode("open").alias("above")).withColumn("key", F.concat("above", F.lit(BEHIND_HOST), "path"))
    )
    fitting = open_intervals(under, rules.select(F.col("rule_key").alias("key"))).where(F.size("open") > 0)
    best = fitting.select("key", F.element_at("open", -1).alias("rule_key")).join(rules.drop("host_key"), "rule_key").drop("rule_key")
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), "rule_host")
    chosen = (
        under.join(best, "key")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), rank).alias("best"))
    )
    return rows.join(chosen, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
