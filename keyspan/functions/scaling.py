"""Feature vectors and min-max scaling over a whole table."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def assemble(df: DataFrame, features: list[str], output: str = "features") -> DataFrame:
    """Add the feature columns as one vector. A null feature is an error: drop such rows first."""
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="error").transform(df)


def _extent(df: DataFrame, features: list[str]) -> Row:
    """Rows, and smallest and largest value of every feature, NaN aside: a single row of numbers, in one pass."""
    numbers = [F.col(c).cast("double") for c in features]
    known = [F.when(~F.isnan(x), x) for x in numbers]
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(x).alias(f"lo{i}") for i, x in enumerate(known)],
        *[F.max(x).alias(f"hi{i}") for i, x in enumerate(known)],
    ).first()


def _scaled(column: str, lo: float | None, hi: float | None) -> Column:
    x = F.col(column).cast("double")
    if lo is None:
        return F.lit(None).cast("double")
    if lo == hi:
        return F.when(x.isNotNull(), F.lit(0.5))
    return (x - F.lit(lo)) / F.lit(hi - lo)


def _minmax(df: DataFrame, features: list[str]) -> tuple[DataFrame, int]:
    extent = _extent(df, features)
    columns = {c: _scaled(c, extent[f"lo{i}"], extent[f"hi{i}"]) for i, c in enumerate(features)}
    return df.withColumns(columns), extent["n"]


def minmax_scale(df: DataFrame, features: list[str]) -> DataFrame:
    """Replace every feature by ``(x - min) / (max - min)``; a constant feature becomes 0.5.

    One aggregate finds the bounds (two numbers per feature reach the driver), the scaling itself is a projection.
    """
    return _minmax(df, features)[0]


def scaled_vectors(df: DataFrame, features: list[str], output: str = "features") -> tuple[DataFrame, int]:
    """``df`` with the scaled features as one vector ``output`` in their place, and its number of rows."""
    scaled, n_rows = _minmax(df, features)
    return assemble(scaled, features, output).drop(*features), n_rows
