"""Bloom filters as Spark bitmaps: few rows of 4096 bytes, of bounded number, to broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.llm.staging import staged
from keyspan.operators.frames import quoted

# Bits in one of Spark's bitmaps, which are binaries of 4096 bytes.
BITMAP = 32768
# A filter has 512 KB at least and 32 MB at most, and 64 slots per row as long as that fits.
MIN_BITS, MAX_BITS = 2**22, 2**28
SPREAD = 64
BUCKET, BITS = "_bm_bucket", "_bm_bits"


def filter_bits(rows: int, spread: int = SPREAD) -> int:
    """Slots of a filter: a power of two that follows the rows, within the bounds of what is broadcast."""
    return max(MIN_BITS, min(MAX_BITS, 1 << max(0, rows * spread - 1).bit_length()))


def slot_of(key: Column, bits: int, seed: int = 1) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits))


def bitmaps_of(slots: DataFrame, slot: str) -> DataFrame:
    """The slots as ``(_bm_bucket, _bm_bits)``, a row per 32768 slots at most."""
    bucket = (F.col(slot) / BITMAP).cast("long").alias(BUCKET)
    return slots.groupBy(bucket).agg(F.bitmap_construct_agg(F.col(slot) % BITMAP).alias(BITS))


def with_bit(rows: DataFrame, bitmaps: DataFrame, slot: str, name: str) -> DataFrame:
    """``rows`` with ``name``: whether the bit of the row's ``slot`` is set."""
    joined = rows.join(F.broadcast(bitmaps), (F.col(slot) / BITMAP).cast("long") == F.col(BUCKET), "left")
    position = F.col(slot) % BITMAP
    byte = F.conv(F.hex(F.substring(F.col(BITS), (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    bit = F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))
    return joined.withColumn(name, bit).drop(BUCKET, BITS)


def marked(rows: DataFrame, key: str, wanted: DataFrame, name: str, spread: int = SPREAD) -> DataFrame:
    """``rows`` with ``name``: whether their ``key`` may be one of the only column of ``wanted``. Null keys are none."""
    column = quoted(key)
    bits = filter_bits(wanted.count(), spread)
    slots = wanted.select(slot_of(F.col(wanted.columns[0]), bits).alias("slot"))
    slotted = rows.withColumn("_bm_slot", F.when(column.isNotNull(), slot_of(column, bits)))
    return with_bit(slotted, staged(bitmaps_of(slots, "slot")), "_bm_slot", name).drop("_bm_slot")


def without_ids(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``rows`` without those whose ``key`` is in ``gone`` (one column). Only rows that the filter marks are shuffled."""
    gone = staged(gone.select(F.col(gone.columns[0]).alias("_bm_gone")).where("_bm_gone is not null"))
    likely = marked(rows, key, gone, "_bm_likely")
    straight = likely.where("not _bm_likely")
    others = likely.where("_bm_likely").join(gone, quoted(key) == F.col("_bm_gone"), "left_anti")
    return straight.union(others).select(*map(quoted, rows.columns))
