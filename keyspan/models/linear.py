"""Linear regression of one label on one feature, for every key.

With the squared-error loss the fit of a key is a formula over its moments, and so is its error, so all keys are one aggregation of
one read: partial sums before the shuffle, no loop over keys, no limit on their number. Only where the points of a key are so close to
their line that a difference of moments would lose the digits (``NEAR``) the residuals of those keys are summed in a second read.
Loss ``huber`` is one aggregation per iteration for all keys. The ``l-bfgs`` solver is Spark ML's, one fit per key.
"""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.functions.scaling import assemble
from keyspan.models.huber import huber_fits
from keyspan.models.per_key import distinct_keys, fit_each_key
from keyspan.models.rules import Rule, apply_rules, between, is_bool, not_blank
from keyspan.operators.frames import drop_incomplete, filter_keys, quoted
from keyspan.sources.storage import rows_with_key, staged_by_key, written

# Share of a label's spread below which an error is not taken from moments: they know it to about 1e-16 of the spread.
NEAR = 1e-6

# Request parameter, Spark ML parameter, accepted values, value used otherwise.
LR_RULES = (
    Rule("loss", "loss", not_blank, "squaredError"),
    Rule("solver", "solver", not_blank, "auto"),
    Rule("aggregation_depth", "aggregationDepth", between(2, 10), 2),
    Rule("max_iterations", "maxIter", between(0, 99), 10),
    Rule("elastic_net", "elasticNetParam", between(0.0, 1.0), 0.0),
    Rule("epsilon", "epsilon", between(1.0, 10.0, open_low=True), 1.35),
    Rule("reg_param", "regParam", between(0.0, 10.0), 0.5),
    Rule("tolerance", "tol", between(0.0, 10.0), 1e-6),
    Rule("fit_intercept", "fitIntercept", is_bool, True),
    Rule("standardization", "standardization", is_bool, True),
)

CLOSED_FORM_SOLVERS = ("auto", "normal")


def lr_params(**raw) -> dict:
    """Spark ML parameters from request parameters; missing ones and those out of range take the default."""
    return apply_rules(LR_RULES, raw)


def _closed_form(rows: DataFrame, key: str, params: dict, history: bool) -> DataFrame:
    """Elastic-net least squares per key from population moments of ``x`` and ``y``.

    With an L1 share the minimum is one step of coordinate descent from zero: a history of two values of the standardised objective.
    """
    reg, alpha = params["regParam"], params["elasticNetParam"]
    centred, standardized = params["fitIntercept"], params["standardization"]
    x, y = F.col("_x"), F.col("_y")
    aggs = [
        F.avg(x).alias("_mx"),
        F.avg(y).alias("_my"),
        F.var_pop(x).alias("_vx"),
        F.var_pop(y).alias("_vy"),
    ]
    if centred:
        aggs.append(F.covar_pop(x, y).alias("_xy"))
    else:
        aggs += [F.avg(x * y).alias("_xy"), F.avg(x * x).alias("_xx"), F.avg(y * y).alias("_yy")]
    moments = rows.groupBy(quoted(key)).agg(*aggs)
    moments = moments.withColumns({"_sx": F.sqrt("_vx"), "_sy0": F.sqrt("_vy")})
    if centred:
        moments = moments.withColumnsRenamed({"_vx": "_xx", "_vy": "_yy"})

    sx = F.col("_sx")
    # Without an intercept a constant label still has a slope; it is then measured in units of its own size.
    sy = F.when(F.col("_sy0") > 0, F.col("_sy0"))
    if not centred:
        sy = F.coalesce(sy, F.when(F.col("_my") != 0, F.abs("_my")))
    scale = sy if standardized else sy * sx
    l1 = F.lit(reg * alpha) / scale
    l2 = F.lit(reg * (1 - alpha)) / (scale if standardized else scale * sx)
    corr = F.col("_xy") / (sx * sy)
    curvature = F.col("_xx") / (sx * sx)
    shrunk = F.signum(corr) * F.greatest(F.abs(corr) - l1, F.lit(0.0))
    slope = F.when((sx > 0) & sy.isNotNull(), shrunk / (curvature + l2) * sy / sx).otherwise(F.lit(0.0))

    shrunken = slope * sx / sy
    at_zero = F.col("_yy") / (sy * sy) / 2
    objective = F.when(
        (sx > 0) & sy.isNotNull(), at_zero - shrunken * corr + shrunken * shrunken * (curvature + l2) / 2 + l1 * F.abs(shrunken)
    )
    b = F.col("_slope")
    from_moments = F.greatest(F.col("_yy") - 2 * b * F.col("_xy") + b * b * F.col("_xx"), F.lit(0.0))
    fits = moments.select(
        quoted(key), slope.alias("_slope"), "_mx", "_my", "_xx", "_xy", "_yy", F.array(F.coalesce(at_zero, F.lit(0.0)), F.coalesce(objective, at_zero, F.lit(0.0))).alias("_steps")
    ).withColumns({"_intercept": F.col("_my") - b * F.col("_mx") if centred else F.lit(0.0), "_error": from_moments})
    fits = written(fits)
    near = fits.where((b != 0) & (F.col("_error") <= NEAR * F.col("_yy")))
    if not near.isEmpty():
        centre_y, centre_x = (F.col("_my"), F.col("_mx")) if centred else (F.lit(0.0), F.lit(0.0))
        residual = (y - centre_y) - b * (x - centre_x)
        summed = rows.join(near.select(quoted(key), "_slope", "_mx", "_my"), key).groupBy(quoted(key)).agg(F.avg(residual * residual).alias("_exact"))
        fits = fits.join(summed, key, "left").withColumn("_error", F.coalesce("_exact", "_error"))
    error = F.col("_error")
    explained = F.when(b == 0, F.lit(0.0)).otherwise(1 - error / F.col("_yy"))
    plain = reg * alpha == 0
    steps = F.array(F.lit(0.0)) if plain else F.col("_steps") if history else F.lit(None)
    return fits.select(
        quoted(key),
        F.lit(0 if plain else 1 if history else None).cast("int").alias("total_iterations"),
        F.sqrt(error).alias("rmse"),
        F.when(F.col("_yy") > 0, explained).alias("r2"),
        F.col("_intercept").alias("intercept"),
        F.array(b).alias("slope_coefficients"),
        steps.cast("array<double>").alias("objective_history"),
    )


def _huber(rows: DataFrame, key: str, params: dict) -> DataFrame:
    fits = huber_fits(rows.select(quoted(key).alias("key"), F.col("_x").alias("x"), F.col("_y").alias("y")), params)
    columns = ["total_iterations", "rmse", "r2", "intercept", F.array("slope").alias("slope_coefficients"), "objective_history"]
    return fits.select(F.col("key").alias(key), *columns)


def _number(value: float) -> float | None:
    return None if value != value else float(value)


def _fit_by_iteration(rows: DataFrame, key: str, keys: list, params: dict, parallelism: int) -> DataFrame:
    spark: SparkSession = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    estimator = LinearRegression(featuresCol="features", labelCol="_y", **params)
    with staged_by_key(rows, key) as staged:

        def fit(value):
            own = assemble(rows_with_key(staged, key, value), ["_x"])
            if own.isEmpty():
                return None
            model = estimator.fit(own)
            summary = model.summary
            return (
                value,
                int(summary.totalIterations),
                _number(summary.rootMeanSquaredError),
                _number(summary.r2),
                float(model.intercept),
                [float(c) for c in model.coefficients],
                [float(v) for v in summary.objectiveHistory],
            )

        answers = fit_each_key(spark, keys, fit, parallelism)
    schema = (
        f"`{key}` {kind}, total_iterations int, rmse double, r2 double, intercept double, "
        "slope_coefficients array<double>, objective_history array<double>"
    )
    return spark.createDataFrame([a for a in answers if a is not None], schema)


def linear_regression(
    df: DataFrame,
    key: str,
    features: str | list[str],
    label: str,
    keys: list | DataFrame | None = None,
    history: bool = True,
    parallelism: int = 4,
    **params,
) -> DataFrame:
    """Fit ``label`` on exactly one feature for every key (or the given ``keys``).

    ``(key, total_iterations, rmse, r2, intercept, slope_coefficients[], objective_history[])``. Keys without complete rows
    have no answer. Iterations and history are those of the method used here (see ``_closed_form`` and ``huber_fits``), of Spark ML
    with the ``l-bfgs`` solver; with ``history=False`` those of fits with an L1 share are null.
    """
    names = [features] if isinstance(features, str) else list(features)
    if len(names) != 1:
        raise ValueError(f"linear regression takes exactly one feature, not {len(names)}")
    settings = lr_params(**params)
    rows = df if keys is None else filter_keys(df, key, keys)
    rows = drop_incomplete(
        rows.select(quoted(key), _as_number(df, names[0]).alias("_x"), _as_number(df, label).alias("_y")),
        [key, "_x", "_y"],
    )
    if settings["loss"] == "huber":
        return _huber(rows, key, settings)
    if settings["loss"] == "squaredError" and settings["solver"] in CLOSED_FORM_SOLVERS:
        return _closed_form(rows, key, settings, history)
    wanted = keys if isinstance(keys, list) else distinct_keys(rows, key)
    return _fit_by_iteration(rows, key, list(dict.fromkeys(wanted)), settings, parallelism)


def _as_number(df: DataFrame, name: str) -> Column:
    """A numeric column as double; a date or timestamp as seconds since 1970."""
    kind = df.schema[name].dataType.simpleString()
    column = quoted(name)
    if kind == "timestamp":
        return F.unix_micros(column) / F.lit(1e6)
    if kind in ("date", "timestamp_ntz"):
        seconds = F.unix_date(F.to_date(column)) * F.lit(86400.0)
        if kind == "timestamp_ntz":
            of_day = F.hour(column) * 3600 + F.minute(column) * 60
            seconds = seconds + of_day + F.extract(F.lit("SECOND"), column).cast("double")
        return seconds
    return column.cast("double")
