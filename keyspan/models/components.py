"""How many principal components explain a wanted share of the variance."""

from __future__ import annotations

from itertools import accumulate

from pyspark.ml.feature import PCA
from pyspark.sql import DataFrame

from keyspan.functions.scaling import assemble
from keyspan.operators.frames import drop_incomplete, quoted


def explained_variance(df: DataFrame, features: list[str], k: int) -> list[float]:
    """Variance shares of the first ``k`` components, largest first."""
    rows = drop_incomplete(df.select(*[quoted(c).cast("double").alias(c) for c in features]), features)
    model = PCA(k=k, inputCol="features", outputCol="components").fit(assemble(rows, features).select("features"))
    return [float(v) for v in model.explainedVariance]


def components_for(shares: list[float], target: float = 0.95) -> int:
    """Smallest number of components whose shares add up to ``target``, all of them if none do."""
    for n, total in enumerate(accumulate(shares), start=1):
        if total >= target:
            return n
    return len(shares)


def components_for_variance(df: DataFrame, features: list[str], k: int, target: float = 0.95) -> int:
    return components_for(explained_variance(df, features, k), target)
