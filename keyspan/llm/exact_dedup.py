"""Exact deduplication by two passes over a Bloom filter (operator 8), DataFrame functions only.

Texts are equal when they are identical after every run of ``[\\x20\\x09-\\x0D]`` became one space. The first pass
counts the rows of each of a filter's slots and keeps the slots of two rows or more as bitmaps; rows that share one are put into a
second filter by another hash. The second pass looks every row up: a row with a slot of its own has no copy and passes straight
through; the others are shuffled and compared by SHA-256. Of all rows the first pass shuffles a slot number each, combined
before, never a text or a digest.

Defined cases: a null text is the empty text, and all empty texts are copies of one another. Of equal texts the row
with the smallest id stays; a null id counts as larger than any other. Rows repeating one id with one text are copies
of each other in ``group_size`` and are all marked ``kept``; :func:`drop_duplicates` returns one of them. Other
columns, whatever their names, are untouched.

The filter is broadcast, so its size is bounded: twice 32 MB. Up to 10**8 rows it lets nearly no unique row into the
shuffle; beyond that the share grows until every row is shuffled, with the same result.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.llm.bitmaps import bitmaps_of, filter_bits, slot_of, with_bit
from keyspan.llm.staging import staged
from keyspan.operators.frames import quoted

_PREFIX = "_dd_"
SHA, SLOT, SHARED, KEEP = (f"{_PREFIX}{x}" for x in ("sha", "slot", "shared", "keep"))


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_sha256(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def repeated_slots(hashes: DataFrame, bits: int, seed: int) -> DataFrame:
    """Bitmaps of the slots that two rows or more fall into, ``bits`` / 32768 rows at most."""
    slots = hashes.select(slot_of(F.col(SHA), bits, seed).alias("slot"))
    return bitmaps_of(slots.groupBy("slot").count().where("count > 1"), "slot")


def _marked(rows: DataFrame, filters: list[DataFrame], bits: int) -> DataFrame:
    """``rows`` with ``_dd_shared``, whether each filter has the row's slot."""
    for seed, bitmaps in enumerate(filters, 1):
        rows = with_bit(rows.withColumn(SLOT, slot_of(F.col(SHA), bits, seed)), bitmaps, SLOT, f"{SHARED}{seed}").drop(SLOT)
    found = [f"{SHARED}{seed}" for seed in range(1, len(filters) + 1)]
    return rows.withColumn(SHARED, reduce(and_, map(F.col, found))).drop(*found)


def _filters(hashes: DataFrame) -> tuple[list[DataFrame], int]:
    """First pass: a filter over all rows, and a second one over the rows that the first lets through."""
    bits = filter_bits(hashes.count())
    first = staged(repeated_slots(hashes, bits, 1))
    likely = _marked(hashes, [first], bits).where(SHARED)
    return [first, staged(repeated_slots(likely, bits, 2))], bits


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    hashes = staged(docs.select(quoted(doc_id).alias("doc_id"), text_sha256(quoted(text)).alias(SHA)))
    marked = staged(_marked(hashes, *_filters(hashes)))
    alone = marked.where(~F.col(SHARED)).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), SHA)
    shared = marked.where(SHARED).select("doc_id", SHA)
    groups = shared.groupBy(F.col(SHA).alias("_dd_group")).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    grouped = shared.join(groups, F.col(SHA) == F.col("_dd_group")).select("doc_id", "keep_id", "group_size", SHA)
    return alone.union(grouped).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col(SHA).alias("text_sha256")
    )


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of equal texts each. Only rows that may have a copy are shuffled."""
    rows = docs.withColumn(SHA, text_sha256(quoted(text)))
    hashes = staged(rows.select(quoted(doc_id).alias("doc_id"), SHA))
    filters, bits = _filters(hashes)
    marked = _marked(rows, filters, bits)
    alone = marked.where(~F.col(SHARED)).select(*map(quoted, docs.columns))
    # Which of several rows with the smallest id stays is open; the rest of the group goes before any text is compared.
    shared = marked.where(SHARED).drop(SHARED)
    firsts = _marked(hashes, filters, bits).where(SHARED).groupBy(F.col(SHA).alias("_dd_group")).agg(F.min("doc_id").alias(KEEP))
    kept = shared.join(firsts, (F.col(SHA) == F.col("_dd_group")) & quoted(doc_id).eqNullSafe(F.col(KEEP)), "left_semi")
    return alone.union(kept.dropDuplicates([SHA]).select(*map(quoted, docs.columns)))
