"""Line deduplication by distinct-site spread (operator 3), DataFrame functions only.

A line is boilerplate when documents of ``MIN_SITES`` sites or more have it. A HyperLogLog sketch of the sites per
line hash merges by aggregation, so a line that every document has is a few bytes per task. Estimates well below or
above the threshold decide by themselves; lines whose estimate is near it get an exact distinct count. Boilerplate
lines are then taken out of every document.

Lines are compared after white space became single spaces, without leading and trailing ones, by 64-bit hashes.

Defined cases: a null text stays null, an empty one empty. Blank lines are no boilerplate and stay. A null site counts
as a site of its own. A row repeating an id and text has the same lines taken out. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.llm.staging import staged
from keyspan.operators.frames import quoted

MIN_SITES = 8
# Buckets of a sketch, as a power of two: a relative error of 1.04 / sqrt(512), 4.6 %.
LG_BUCKETS = 9
# Estimates within so many standard errors of the threshold are counted exactly.
ERRORS = 4


def line_key(line: Column) -> Column:
    return F.btrim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``line`` of ``lines`` (``line, site``) that ``min_sites`` sites or more have."""
    error = ERRORS * 1.04 / 2 ** (LG_BUCKETS / 2)
    spread = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_BUCKETS)).alias("sketch"), F.count("*").alias("rows")).where(F.col("rows") >= min_sites)
    spread = staged(spread.select("line", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - error)))
    near = spread.where(F.col("sites") <= min_sites * (1 + error)).select("line")
    counted = lines.join(near, "line").groupBy("line", "site").count().groupBy("line").count().where(F.col("count") >= min_sites)
    return spread.where(F.col("sites") > min_sites * (1 + error)).select("line").union(counted.select("line"))


def _flags(places: Column) -> Column:
    """Sorted places as an array of 0 and 1 up to the last of them: a line looks up its own, however many others there are."""

    def up_to(place: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get(places, i - 1))
        return F.concat(F.repeat(F.lit("0"), place - before - 1), F.lit("1"))

    return F.split(F.array_join(F.transform(places, up_to), ""), "")


def remove_boilerplate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``doc_id, n_lines, n_removed, text`` per row of ``docs``."""
    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"), F.coalesce(F.xxhash64(quoted(site).cast("string")), F.lit(0)).alias("site"))
    # Keeps rows of one id and different texts apart.
    rows = rows.withColumn("mark", F.xxhash64("doc_id", "text"))
    each = rows.select("mark", "site", F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("line", line_key(F.col("line")))
    each = staged(each.where("line != ''").select("mark", "site", "no", F.xxhash64("line").alias("line")))
    boilerplate = staged(boilerplate_lines(each.select("line", "site"), min_sites))
    removed = each.join(boilerplate, "line").groupBy("mark").agg(F.sort_array(F.collect_set("no")).alias("places"))
    removed = removed.select("mark", F.size("places").alias("n_removed"), _flags(F.col("places")).alias("flags"))
    lines = F.split("text", "\n")
    # Lines behind the last flag stay.
    kept = F.filter(lines, lambda _, no: F.coalesce(F.get("flags", no) != "1", F.lit(True)))
    return rows.join(removed, "mark", "left").select(
        "doc_id",
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("flags").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
