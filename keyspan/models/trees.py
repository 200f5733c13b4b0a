"""Random forests and gradient-boosted trees per key, with fixed parameters or a grid search.

Spark ML grows the trees, one fit per key, each distributed over the cluster. The cost grows with the number of keys times
the rows of a key, so this is for the keys somebody asked for, each with as many rows as there are. Every draw (split, sample,
folds) hangs on hashes of the row id, made once per row, and training rows are laid out by them, so that a fit does not depend
on how the table was stored.

Where rows are many and the settings draw none of them for themselves, rows with equal features go to Spark ML as one weighted row
(``cells``): same sums, same splits, and the fits no longer grow with the copies. Such models name ``_n`` as their weight column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import product

from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.functions.metrics import regression_metrics
from keyspan.functions.sampling import below, id_hash, nth_fold
from keyspan.functions.scaling import assemble
from keyspan.models.cells import CELL_ROWS, ROWS, SPREAD, cells
from keyspan.models.layout import laid_out
from keyspan.models.per_key import fit_each_key
from keyspan.models.rules import Rule, apply_rules, between, is_bool, not_blank
from keyspan.operators.frames import drop_incomplete, filter_keys, quoted
from keyspan.sources.storage import FOLDER, rows_with_key, staged_by_key, written

# Three independent draws per row; together they also stand for the row's id.
DRAWS = ("split", "sample", "fold")
DRAW_COLUMNS = [f"_{purpose}" for purpose in DRAWS]
TIE = 1e-9

# Request parameter, Spark ML parameter, accepted values, value used otherwise (none: Spark's own default).
SHARED_RULES = (
    Rule("subsampling_rate", "subsamplingRate", between(0.0, 1.0, open_low=True)),
    Rule("feature_subset_strategy", "featureSubsetStrategy", not_blank),
    Rule("impurity", "impurity", not_blank),
    Rule("max_depth", "maxDepth", between(1)),
    Rule("max_bins", "maxBins", between(1)),
    Rule("train_split", "train_split", between(0.0, 1.0, open_low=True, open_high=True), 0.8),
    Rule("min_info_gain", "minInfoGain", between(0.0, open_low=True)),
    Rule("min_instances_per_node", "minInstancesPerNode", between(1)),
    Rule("min_weight_fraction", "minWeightFractionPerNode", between(0.0, 0.5, open_high=True)),
)
TREE_RULES = {
    "random_forest": SHARED_RULES
    + (
        Rule("is_bootstrap", "bootstrap", is_bool),
        Rule("num_trees", "numTrees", between(1), 1),
    ),
    "gradient_boost": SHARED_RULES
    + (
        Rule("step_size", "stepSize", between(0.0, 1.0, open_low=True)),
        Rule("loss_type", "lossType", not_blank),
        Rule("max_iter", "maxIter", between(1)),
    ),
}
ESTIMATORS = {"random_forest": RandomForestRegressor, "gradient_boost": GBTRegressor}

# The settings an exhaustive search goes through.
RF_GRID = {
    "maxBins": [32, 50, 100],
    "maxDepth": [3, 4, 5],
    "subsamplingRate": [0.25, 0.5, 1.0],
    "minWeightFractionPerNode": [0.1, 0.25, 0.45],
}
GBT_GRID = {
    "maxBins": [32, 50, 100],
    "maxDepth": [3, 4, 5],
    "maxIter": [10, 15, 20],
}
GRIDS = {"random_forest": RF_GRID, "gradient_boost": GBT_GRID}


@dataclass
class Trained:
    """``metrics (key, rmse, r2)``, the model of every key, and for a grid search ``scores (key, setting, avg_rmse)``."""

    metrics: DataFrame
    models: dict
    scores: DataFrame | None = None


def tree_params(kind: str, **raw) -> dict:
    """Spark ML parameters (and ``train_split``) from request parameters; those out of range take the default."""
    return apply_rules(TREE_RULES[kind], raw)


def estimator_for(kind: str, settings: dict, seed: int):
    return ESTIMATORS[kind](featuresCol="features", labelCol="label", seed=seed, **settings)


@dataclass(frozen=True)
class Apart:
    """What the fits to come tell rows apart by, besides their features."""

    train_split: float
    fractions: tuple[float, ...] = ()
    folds: tuple[int, ...] = ()


def apart(kind: str, settings: list[dict], train_split: float, fractions: tuple[float, ...] = (), folds: tuple[int, ...] = ()) -> Apart | None:
    """None where one of the settings draws rows for itself, counts them one by one, or looks at more than their mean label."""
    for s in settings:
        drawn = s.get("subsamplingRate", 1.0) < 1 or (kind == "random_forest" and s.get("bootstrap", True))
        if drawn or s.get("minInstancesPerNode", 1) > 1 or s.get("lossType", "squared") != "squared":
            return None
    return Apart(train_split, tuple(fractions), tuple(folds))


def rows_of_keys(df: DataFrame, key: str, keys: list | DataFrame | None) -> DataFrame:
    """Rows of the wanted keys, all of them for None.

    A table of keys is written first: Spark then sees its size and broadcasts a small one. What it cannot tell the size of it joins by
    shuffling all rows on the key, and a large key's into one task.
    """
    if isinstance(keys, DataFrame):
        keys = written(keys.select(quoted(key)).distinct())
    return df if keys is None else filter_keys(df, key, keys)


@contextmanager
def training_table(
    df: DataFrame,
    key: str,
    features: list[str],
    label: str,
    row_id: str | list[str],
    keys: list | DataFrame | None = None,
    seed: int = 1,
    known: Apart | None = None,
) -> Iterator[DataFrame]:
    """Complete rows ``(draws..., key, _f0, _f1, ..., label)`` of the wanted keys, laid out by key; many rows as cells where ``known`` says what
    tells them apart, with their number and spread. A key's rows are read by ``rows_of``."""
    if not features:
        raise ValueError("a tree model needs at least one feature")
    rows = rows_of_keys(df, key, keys).select(
        *[id_hash(row_id, purpose, seed).alias(c) for purpose, c in zip(DRAWS, DRAW_COLUMNS)],
        quoted(key),
        *[quoted(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)],
        quoted(label).cast("double").alias("label"),
    )
    inputs = [f"_f{i}" for i in range(len(features))]
    rows = drop_incomplete(rows, [key, *inputs, "label"])
    own = []
    if known is not None and rows.count() > CELL_ROWS:
        by = [quoted(key), *map(F.col, inputs)]
        rows = cells(rows, by, "label", DRAW_COLUMNS, known.train_split, list(known.fractions), list(known.folds))
        own = [ROWS, SPREAD]
    with staged_by_key(rows, key) as staged:
        yield staged.select(*DRAW_COLUMNS, quoted(key), *inputs, "label", *own, FOLDER)


def rows_of(table: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key of a ``training_table`` with their ``features`` as a vector, from its folder only.

    Vectors come last: Spark takes no condition on the folder past them and would read every key's.
    """
    rows = rows_with_key(table, key, value).drop(quoted(key))
    inputs = [c for c in rows.columns if re.fullmatch(r"_f\d+", c)]
    return assemble(rows, inputs).drop(*inputs)


def sampled(rows: DataFrame, fraction: float) -> DataFrame:
    return rows.where(below(F.col("_sample"), fraction))


def training_counts(table: DataFrame, key: str, train_split: float, fractions: tuple[float, ...] = (1.0,)) -> dict:
    """Training rows of every key, a list with one number per sample fraction: one aggregation for all fits to come."""
    in_train = below(F.col("_split"), train_split)
    counts = [F.sum((in_train & below(F.col("_sample"), f)).cast("long")).alias(f"n{i}") for i, f in enumerate(fractions)]
    rows = table.groupBy(quoted(key).alias("_key")).agg(*counts).toLocalIterator()
    return {r["_key"]: [r[f"n{i}"] for i in range(len(fractions))] for r in rows}


def _training_rows(rows: DataFrame, train_split: float, n_rows: int) -> tuple[DataFrame | None, DataFrame]:
    """Training and test rows, the former (``n_rows`` of them) laid out, or None where there are none."""
    in_train = below(F.col("_split"), train_split)
    return (laid_out(rows.where(in_train), n_rows, DRAW_COLUMNS) if n_rows else None), rows.where(~in_train)


def accuracy(model, test: DataFrame) -> tuple[float | None, float | None]:
    """``rmse, r2`` on held-out rows or cells; nothing when there are none."""
    pairs = model.transform(test)
    if ROWS not in test.columns:
        row = regression_metrics(pairs).first()
        return row["rmse"], row["r2"]
    n, off = F.col(ROWS), F.col("label") - F.col("prediction")
    mean = test.agg(F.sum(n * F.col("label")) / F.sum(n)).first()[0]
    spread = F.col("label") - F.lit(mean)
    row = pairs.agg(F.sum(n).alias("n"), F.sum(F.col(SPREAD) + n * off * off).alias("sse"), F.sum(F.col(SPREAD) + n * spread * spread).alias("all")).first()
    return ((row["sse"] / row["n"]) ** 0.5, 1 - row["sse"] / row["all"] if row["all"] > 0 else None) if row["n"] else (None, None)


def weighted(estimator, rows: DataFrame):
    return estimator.copy({estimator.weightCol: ROWS}) if ROWS in rows.columns else estimator


def fit_and_test(rows: DataFrame, estimator, train_split: float, n_rows: int):
    """Model and accuracy of one key with ``n_rows`` training rows, or None when it has none."""
    train, test = _training_rows(rows, train_split, n_rows)
    if train is None:
        return None
    model = weighted(estimator, rows).fit(train)
    return (model, *accuracy(model, test))


def first_best(scores: list[float | None]) -> int:
    """Position of the smallest score. Scores apart by rounding noise only are equal: the earlier setting wins."""
    known = [s for s in scores if s is not None]
    if not known:
        return 0
    bound = min(known) * (1 + TIE)
    return next(i for i, s in enumerate(scores) if s is not None and s <= bound)


def grid_settings(grid: dict) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def _fits(kind: str, settings: list[dict]) -> list[tuple[dict, list[int]]]:
    """Settings to fit, each with the positions in ``settings`` that it answers.

    Boosting adds one tree after the other, so settings that differ in ``maxIter`` only are stages of the longest of them.
    """
    groups: dict[tuple, list[int]] = {}
    for i, setting in enumerate(settings):
        shared = tuple(v for n, v in sorted(setting.items()) if kind != "gradient_boost" or n != "maxIter")
        groups.setdefault(shared, []).append(i)
    return [(settings[max(which, key=lambda i: settings[i].get("maxIter", 0))], which) for which in groups.values()]


def _stage_errors(model, test: DataFrame, stages: list[int | None]) -> list[float]:
    """The rmse of the model's first so many trees on ``test``, or of all of them for None; one pass."""
    if stages == [None]:
        return [accuracy(model, test)[0]]
    errors = model.evaluateEachIteration(test, "squared")
    # A cell's labels are off its mean as well.
    within = test.agg(F.sum(SPREAD) / F.sum(ROWS)).first()[0] if ROWS in test.columns else 0.0
    return [(errors[(n or len(errors)) - 1] + within) ** 0.5 for n in stages]


def search_and_test(
    rows: DataFrame, kind: str, base: dict, grid: dict, folds: int, parallelism: int, train_split: float, seed: int, n_rows: int
):
    """Cross-validated choice among the grid's settings, then the best one on all training rows.

    Folds come from the row ids, and every setting is scored by its mean rmse over them.
    """
    spark = rows.sparkSession
    train, test = _training_rows(rows, train_split, n_rows)
    if train is None:
        return None
    train = train.withColumn("_fold", nth_fold(F.col("_fold"), folds)).persist()
    try:
        settings = grid_settings(grid)
        # A fold can be scored when it has rows and leaves some to train on; a key of a few rows may have none.
        filled = sorted(r["_fold"] for r in train.select("_fold").distinct().collect())
        usable = filled if len(filled) > 1 else []

        def score(task):
            setting, which, fold = task
            model = weighted(estimator_for(kind, {**base, **setting}, seed), rows).fit(train.where(F.col("_fold") != fold))
            stages = [settings[i].get("maxIter") if kind == "gradient_boost" else None for i in which]
            return list(zip(which, _stage_errors(model, train.where(F.col("_fold") == fold), stages)))

        tasks = [(setting, which, fold) for setting, which in _fits(kind, settings) for fold in usable]
        errors: dict[int, list[float]] = {}
        for found in fit_each_key(spark, tasks, score, parallelism):
            for i, error in found:
                errors.setdefault(i, []).append(error)
        means = [sum(errors[i]) / len(errors[i]) if i in errors else None for i in range(len(settings))]
        best = first_best(means)
        model = weighted(estimator_for(kind, {**base, **settings[best]}, seed), rows).fit(train)
        return (model, *accuracy(model, test), list(zip(settings, means)))
    finally:
        train.unpersist()


def _key_type(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def _collected(df: DataFrame, key: str, keys: list, answers: list, with_scores: bool) -> Trained:
    spark, kind = df.sparkSession, _key_type(df, key)
    done = [(k, a) for k, a in zip(keys, answers) if a is not None]
    metrics = spark.createDataFrame(
        [(k, a[1], a[2]) for k, a in done], f"`{key}` {kind}, rmse double, r2 double"
    )
    scores = None
    if with_scores:
        scores = spark.createDataFrame(
            [(k, {n: float(v) for n, v in s.items()}, m) for k, a in done for s, m in a[3]],
            f"`{key}` {kind}, setting map<string,double>, avg_rmse double",
        )
    return Trained(metrics, {k: a[0] for k, a in done}, scores)


def _train(kind, df, key, features, label, row_id, keys, seed, parallelism, params) -> Trained:
    settings = tree_params(kind, **params)
    train_split = settings.pop("train_split")
    with training_table(df, key, features, label, row_id, keys, seed, apart(kind, [settings], train_split)) as table:
        counts = training_counts(table, key, train_split)
        wanted = list(dict.fromkeys(keys)) if isinstance(keys, list) else sorted(counts)
        answers = fit_each_key(
            df.sparkSession,
            wanted,
            lambda v: fit_and_test(
                rows_of(table, key, v), estimator_for(kind, settings, seed), train_split, counts.get(v, [0])[0]
            ),
            parallelism,
        )
    return _collected(df, key, wanted, answers, with_scores=False)


def random_forest(
    df: DataFrame,
    key: str,
    features: list[str],
    label: str,
    row_id: str | list[str],
    keys: list | DataFrame | None = None,
    seed: int = 1,
    parallelism: int = 4,
    **params,
) -> Trained:
    """A random forest per key, tested on the rows held out by ``train_split``. Keys without rows have no answer."""
    return _train("random_forest", df, key, features, label, row_id, keys, seed, parallelism, params)


def gradient_boost(
    df: DataFrame,
    key: str,
    features: list[str],
    label: str,
    row_id: str | list[str],
    keys: list | DataFrame | None = None,
    seed: int = 1,
    parallelism: int = 4,
    **params,
) -> Trained:
    """Gradient-boosted trees per key, tested on the rows held out by ``train_split``."""
    return _train("gradient_boost", df, key, features, label, row_id, keys, seed, parallelism, params)


def _search(kind, df, key, features, label, row_id, keys, grid, folds, parallelism, key_parallelism, seed, params):
    settings = tree_params(kind, **params)
    train_split = settings.pop("train_split")
    chosen_grid = GRIDS[kind] if grid is None else grid
    known = apart(kind, [{**settings, **s} for s in grid_settings(chosen_grid)], train_split, folds=(folds,))
    with training_table(df, key, features, label, row_id, keys, seed, known) as table:
        counts = training_counts(table, key, train_split)
        wanted = list(dict.fromkeys(keys)) if isinstance(keys, list) else sorted(counts)
        answers = fit_each_key(
            df.sparkSession,
            wanted,
            lambda v: search_and_test(
                rows_of(table, key, v), kind, settings, chosen_grid, folds, parallelism, train_split, seed, counts.get(v, [0])[0]
            ),
            key_parallelism,
        )
    return _collected(df, key, wanted, answers, with_scores=True)


def random_forest_exhaustive(
    df: DataFrame,
    key: str,
    features: list[str],
    label: str,
    row_id: str | list[str],
    keys: list | DataFrame | None = None,
    grid: dict | None = None,
    folds: int = 3,
    parallelism: int = 2,
    key_parallelism: int = 4,
    seed: int = 1,
    **params,
) -> Trained:
    """The best random forest of a grid (``RF_GRID``, 81 settings) per key, by cross-validation."""
    return _search(
        "random_forest", df, key, features, label, row_id, keys, grid, folds, parallelism, key_parallelism, seed, params
    )


def gradient_boost_exhaustive(
    df: DataFrame,
    key: str,
    features: list[str],
    label: str,
    row_id: str | list[str],
    keys: list | DataFrame | None = None,
    grid: dict | None = None,
    folds: int = 3,
    parallelism: int = 2,
    key_parallelism: int = 4,
    seed: int = 1,
    **params,
) -> Trained:
    """The best gradient-boosted trees of a grid (``GBT_GRID``, 27 settings) per key, by cross-validation."""
    return _search(
        "gradient_boost", df, key, features, label, row_id, keys, grid, folds, parallelism, key_parallelism, seed, params
    )


EXHAUSTIVE = {"random_forest": random_forest_exhaustive, "gradient_boost": gradient_boost_exhaustive}
