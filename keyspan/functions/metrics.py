"""Accuracy of predictions, as plain aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression_metrics(
    predictions: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    by: list[str] | None = None,
) -> DataFrame:
    """``n, rmse, r2, r2_swapped`` over all rows, or per group of ``by``.

    ``r2`` relates the errors to the spread of the labels. ``r2_swapped`` relates them to the spread of the predictions,
    for comparison with figures computed with the two columns exchanged. Both are null where that spread is zero.
    """
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    pairs = predictions.where(y.isNotNull() & p.isNotNull())
    sums = pairs.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((y - p) * (y - p)).alias("_sse"),
        F.var_pop(y).alias("_var_y"),
        F.var_pop(p).alias("_var_p"),
    )

    def share(variance: str):
        return F.when(F.col(variance) > 0, 1 - F.col("_sse") / (F.col(variance) * F.col("n")))

    return sums.select(
        *(by or []),
        "n",
        F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"),
        share("_var_y").alias("r2"),
        share("_var_p").alias("r2_swapped"),
    )
