"""Laying out training rows so that a fit with a seed repeats itself."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame

# Training rows of a task while there are few tasks, the number of tasks that counts as few, and rows of a task beyond.
FEW_ROWS = 20_000
FEW_TASKS = 64
MANY_ROWS = 2_000_000


def laid_out(rows: DataFrame, n_rows: int, by: list[str]) -> DataFrame:
    """Rows in partitions and an order given by ``by``, which should differ from row to row.

    Trainers sample per partition and in row order; with this layout they draw the same rows however the table was stored.
    The number of partitions follows the number of rows and nothing else, so sessions of any setting draw alike.
    """
    partitions = max(1, min(ceil(n_rows / FEW_ROWS), FEW_TASKS), ceil(n_rows / MANY_ROWS))
    return rows.repartition(partitions, *by).sortWithinPartitions(*by)
