"""Huber regression of one label on one feature, for every key: one aggregation per iteration for all keys that are not done.

The loss of a residual r is that of Spark ML: with a scale s per key, s + r^2 / s where |r| is at most epsilon s, else
2 epsilon |r| - epsilon^2 s + s, averaged, halved, plus the L2 penalty. Which residuals are beyond epsilon s is known for the current fit;
for that partition the best line and scale follow from sums over the rows of either kind, which are those of one aggregation. The next
one finds the rows that changed sides. A few iterations settle it; after ``STEADY`` of them steps are halved, so that a row
on the border can't keep its key going back and forth.

Feature and label are centred (with an intercept) and the feature is scaled, so sums keep their digits. A key without spread in its residuals
keeps its least-squares line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.sources.storage import written

STEADY = 12
# Steps of the small problem within a partition.
INNER = 200
STATE = ["w", "b", "s", "done", "iterations", "history"]
SUMS = ["n_in", "n_out", "sx", "sxx", "sr", "srx", "srr", "gx", "g", "far", "n"]


def _residual(state: str = "") -> Column:
    return F.col("_v") - F.col(f"{state}w") * F.col("_u") - F.col(f"{state}b")


def _step(sums: pd.DataFrame, settings: dict, turn: int) -> pd.DataFrame:
    """The next line and scale of every key from the sums of its rows at the current one."""
    m, centred = settings["epsilon"], settings["fitIntercept"]
    c = {name: sums[name].to_numpy(float) for name in [*SUMS, "w", "b", "s", "penalty"]}
    w, s0 = c["w"], c["s"]
    loss = (c["n"] * s0 + c["srr"] / s0 + 2 * m * c["far"] - m * m * s0 * c["n_out"]) / (2 * c["n"]) + c["penalty"] * w * w / 2
    room = c["n_in"] + c["n_out"] * (1 - m * m)
    s, dw, db = s0.copy(), np.zeros_like(w), np.zeros_like(w)
    with np.errstate(all="ignore"):
        for _ in range(INNER):
            ridge = c["n"] * s * c["penalty"]
            top, bottom = c["srx"] + m * s * c["gx"] - ridge * w, c["sr"] + m * s * c["g"]
            xx, x, n = c["sxx"] + ridge, c["sx"], c["n_in"]
            if centred:
                det = xx * n - x * x
                usable = det > 1e-14 * xx * n
                dw = np.where(usable, (top * n - x * bottom) / det, 0.0)
                db = np.where(n > 0, (bottom - x * dw) / n, 0.0)
            else:
                dw = np.where(xx > 0, top / xx, 0.0)
            left = c["srr"] - 2 * dw * c["srx"] - 2 * db * c["sr"] + dw * dw * c["sxx"] + 2 * dw * db * c["sx"] + db * db * c["n_in"]
            # Too many far residuals for any scale of this partition: a wider one takes them in.
            new = np.where((room > 0) & (left > 0), np.sqrt(np.maximum(left, 0) / np.where(room > 0, room, 1)), 2 * s0)
            if np.all(np.abs(new - s) <= 1e-15 * s):
                break
            s = new
    wide = ~((room > 0) & (s < 2 * s0))
    dw, db, s = np.where(wide, 0.0, dw), np.where(wide, 0.0, db), np.where(wide, 2 * s0, s)
    share = 1.0 if turn < STEADY else 0.5
    change = np.maximum(np.abs(dw), np.abs(db)) / s0 + np.abs(s - s0) / s0
    out = sums[["key"]].copy()
    out["w"], out["b"], out["s"] = w + share * dw, c["b"] + share * db, s0 + share * (s - s0)
    out["done"] = change <= settings["tol"]
    out["iterations"] = sums["iterations"] + 1
    out["history"] = [[*before, value] for before, value in zip(sums["history"], loss)]
    return out


def huber_fits(rows: DataFrame, settings: dict) -> DataFrame:
    """``key, total_iterations, rmse, r2, intercept, slope, objective_history`` from complete rows ``key, x, y``."""
    if settings["elasticNetParam"] * settings["regParam"] > 0:
        raise ValueError("the Huber loss has no L1 share")
    m, centred = settings["epsilon"], settings["fitIntercept"]
    rows = written(rows)
    x, y = F.col("x"), F.col("y")
    spread = [F.stddev_pop(x).alias("sx"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.covar_pop(x, y).alias("xy"), F.var_pop(x).alias("xx")]
    of_keys = rows.groupBy("key").agg(*spread, F.avg(x * y).alias("xy0"), F.avg(x * x).alias("xx0"), F.var_pop(y).alias("yy"), F.avg(y * y).alias("yy0"))
    zero = F.lit(0.0)
    of_keys = of_keys.select(
        "key",
        F.when(F.col("sx") > 0, F.col("sx")).otherwise(1.0).alias("scale"),
        (F.col("mx") if centred else zero).alias("at_x"),
        (F.col("my") if centred else zero).alias("at_y"),
        (F.col("sx") > 0).alias("varies"),
        F.col("yy" if centred else "yy0").alias("spread"),
        F.col("xy" if centred else "xy0").alias("xy"),
        F.col("xx" if centred else "xx0").alias("xx"),
    )
    slope = F.when(F.col("varies"), F.col("xy") / F.col("xx")).otherwise(0.0)
    penalty = F.lit(settings["regParam"]) / (F.lit(1.0) if settings["standardization"] else F.col("scale") * F.col("scale"))
    of_keys = written(of_keys.withColumns({"w": slope * F.col("scale"), "b": zero, "penalty": penalty}))
    shape = ["key", "scale", "at_x", "at_y", "varies", "spread", "penalty"]
    # A feature that doesn't vary has no slope.
    u = F.when(F.col("varies"), (x - F.col("at_x")) / F.col("scale")).otherwise(0.0)
    placed = written(rows.join(of_keys.select(*shape), "key").select("key", u.alias("_u"), (y - F.col("at_y")).alias("_v")))
    start = placed.join(of_keys.select("key", "w", "b", "spread", "at_y", "penalty"), "key")
    start = start.groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("w", "b", "penalty")],
        F.sqrt(F.avg(_residual() * _residual())).alias("s"),
        F.max(F.abs(F.col("_v") + F.col("at_y"))).alias("size"),
    )
    kind = rows.schema["key"].dataType.simpleString()
    flat = F.col("s") <= 1e-13 * F.col("size")
    state = written(start.select("key", "w", "b", "s", "penalty", flat.alias("done"), F.lit(0).alias("iterations"), F.array().cast("array<double>").alias("history")))
    schema = f"key {kind}, w double, b double, s double, done boolean, iterations int, history array<double>"
    for turn in range(settings["maxIter"]):
        going = state.where(~F.col("done"))
        if going.isEmpty():
            break
        near = F.abs("_r") <= m * F.col("s")

        def total(value: Column, inside: bool, near=near) -> Column:
            return F.sum(F.when(near if inside else ~near, value).otherwise(0.0))

        r, sign = F.col("_r"), F.signum("_r")
        measured = placed.join(going.select("key", "w", "b", "s"), "key").withColumn("_r", _residual())
        sums = measured.groupBy("key").agg(
            total(F.lit(1.0), True).alias("n_in"),
            total(F.lit(1.0), False).alias("n_out"),
            total(F.col("_u"), True).alias("sx"),
            total(F.col("_u") * F.col("_u"), True).alias("sxx"),
            total(r, True).alias("sr"),
            total(r * F.col("_u"), True).alias("srx"),
            total(r * r, True).alias("srr"),
            total(sign * F.col("_u"), False).alias("gx"),
            total(sign, False).alias("g"),
            total(F.abs("_r"), False).alias("far"),
            F.count("*").alias("n"),
        )

        def steps(parts: Iterator[pd.DataFrame], turn=turn) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield _step(part, settings, turn)

        stepped = sums.join(going, "key").mapInPandas(steps, schema).join(going.select("key", "penalty"), "key")
        state = written(stepped.unionByName(state.where("done")))
    fits = placed.join(state, "key").withColumn("_r", _residual())
    fits = fits.groupBy("key").agg(F.avg(F.col("_r") * F.col("_r")).alias("error"), *[F.first(c).alias(c) for c in ("w", "b", "iterations", "history")])
    own = F.when(F.col("varies"), F.col("w") / F.col("scale")).otherwise(0.0)
    return fits.join(of_keys.select(*shape), "key").select(
        "key",
        F.col("iterations").alias("total_iterations"),
        F.sqrt("error").alias("rmse"),
        F.when(F.col("spread") > 0, 1 - F.col("error") / F.col("spread")).alias("r2"),
        (F.col("at_y") + F.col("b") - own * F.col("at_x") if centred else zero).alias("intercept"),
        own.alias("slope"),
        F.col("history").alias("objective_history"),
    )
