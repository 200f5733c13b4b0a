"""Rows that no tree tells apart, as one weighted row.

Trees by variance ask of a set of rows only their number and the sum of their labels, so rows of a key with equal features that are
trained, sampled and left out together can be grown as one: Spark groups them once, and what is grown grows with the different rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.functions.sampling import below, nth_fold

# Rows of a table up to which they are taken one by one.
CELL_ROWS = 500_000
# A cell's number of rows and the sum of squares of their labels about their mean.
ROWS, SPREAD = "_n", "_m2"


def cells(
    rows: DataFrame, by: list[Column], label: str, draws: list[str], train_split: float, fractions: list[float], folds: list[int], sums: list[Column] | None = None
) -> DataFrame:
    """One row for those equal in ``by``, on the same side of ``train_split``, in the same ``fractions`` and the same of so many ``folds``.

    ``label`` is their mean, ``draws`` (split, sample, fold) decide the same as those of each of them.
    """
    split, sample, fold = draws
    train = below(F.col(split), train_split)
    within = [below(F.col(sample), f) for f in sorted(set(fractions)) if f < 1]
    parts = [train, *within, *[F.when(train, nth_fold(F.col(fold), n)) for n in sorted(set(folds))]]
    count = F.count(F.lit(1)).cast("double")
    found = rows.groupBy(*by, *[c.alias(f"_part{i}") for i, c in enumerate(parts)]).agg(
        *[F.min(c).alias(c) for c in draws], F.avg(label).alias(label), count.alias(ROWS), (F.var_pop(label) * count).alias(SPREAD), *(sums or [])
    )
    return found.drop(*[f"_part{i}" for i in range(len(parts))])
