"""Positions of sorted rows within their group, for groups too large for one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.sources.storage import written

# monotonically_increasing_id keeps the partition number above this many bits and the row number below.
ROW_BITS = 33


def numbered(rows: DataFrame, group: str, order: list[str], first: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` and ``_position``: 0, 1, ... within ``group`` in the order of ``order``. ``first`` adds columns of a group's first row.

    The rows are sorted globally and written once, so a lost executor cannot change their numbering. One number per sorted
    partition comes to the driver, and goes back as a table of that size. A position depends on the rows of its own group only.
    """
    sorted_rows = written(rows.sort(group, *order).withColumn("_at", F.monotonically_increasing_id()))
    partition = F.shiftright("_at", ROW_BITS)
    sizes = sorted_rows.groupBy(partition.alias("_partition")).agg(F.count(F.lit(1)).alias("_n")).collect()
    sizes.sort(key=lambda r: r["_partition"])
    starts = accumulate((r["_n"] for r in sizes), initial=0)
    offsets = sorted_rows.sparkSession.createDataFrame(
        [(r["_partition"], start) for r, start in zip(sizes, starts)], "_partition bigint, _start bigint"
    )
    placed = sorted_rows.withColumn("_partition", partition).join(F.broadcast(offsets), "_partition")
    placed = placed.withColumn("_place", F.col("_start") + F.col("_at").bitwiseAND(F.lit(2**ROW_BITS - 1)))
    names = first or {}
    begins = placed.groupBy(group).agg(
        F.min("_place").alias("_begin"), *[F.min_by(c, F.col("_place")).alias(name) for name, c in names.items()]
    )
    return placed.join(begins, group).select(
        *rows.columns, *names, (F.col("_place") - F.col("_begin")).alias("_position")
    )
