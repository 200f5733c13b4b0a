"""Parents and children: the members of a cluster are trained on growing samples until they match their centre.

What passes from a parent to its children are its hyper-parameters and its rmse as the target, no trees.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.models.per_key import fit_each_key
from keyspan.models.trees import (
    EXHAUSTIVE,
    TREE_RULES,
    Trained,
    apart,
    estimator_for,
    fit_and_test,
    rows_of,
    sampled,
    training_counts,
    training_table,
    tree_params,
)
from keyspan.operators.summaries import cluster_centers_of, cluster_members
from keyspan.sources.models import load_models, load_targets, save_models

# The share of a child's rows the first round uses.
START_FRACTION = {"random_forest": 0.3, "gradient_boost": 0.15}
FRACTION_LIMIT = 0.9

HISTORY = (
    "`{key}` {kind}, phase string, round int, fraction double, seconds double, rmse double, r2 double, reached boolean"
)


@dataclass
class Transferred:
    """Models and accuracy of the children, the round by round ``history``, and the children whose parent has no model."""

    metrics: DataFrame
    models: dict
    history: DataFrame
    skipped: list


def hyper_parameters(model, kind: str) -> dict:
    """The settings a model was trained with, also of one loaded from disk."""
    names = {rule.target for rule in TREE_RULES[kind]} - {"train_split"}
    return {p.name: v for p, v in model.extractParamMap().items() if p.name in names}


def growing(start: float, limit: float) -> tuple[float, ...]:
    """``start`` and its doubles up to ``limit``, ``start`` at least: the sample of every round."""
    if not 0.0 < start <= 1.0:
        raise ValueError(f"the first fraction must be in (0, 1], not {start}")
    fractions = [start]
    while fractions[-1] * 2 <= limit:
        fractions.append(fractions[-1] * 2)
    return tuple(fractions)


def train_incremental(
    rows: DataFrame,
    estimator,
    target_rmse: float,
    fractions: tuple[float, ...],
    counts: list[int],
    train_split: float = 0.8,
) -> tuple:
    """Fit on a sample of the rows, then on the next larger one, until the test rmse is below the target or none is left.

    ``rows`` are those of one key of a ``training_table``, ``counts`` its training rows per fraction. Returns the model with
    the smallest rmse and one ``(round, fraction, seconds, rmse, r2, reached)`` per round.
    """
    best, best_rmse, rounds = None, None, []
    for fraction, n_rows in zip(fractions, counts):
        began = time.monotonic()
        answer = fit_and_test(sampled(rows, fraction), estimator, train_split, n_rows)
        model, rmse, r2 = answer or (None, None, None)
        reached = rmse is not None and rmse < target_rmse
        rounds.append((len(rounds), fraction, time.monotonic() - began, rmse, r2, reached))
        if model is not None and (best is None or (rmse is not None and (best_rmse is None or rmse < best_rmse))):
            best, best_rmse = model, rmse
        if reached:
            break
    return best, rounds


def _history(df: DataFrame, key: str, rows: list) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, HISTORY.format(key=key, kind=kind))


def _transferred(df: DataFrame, key: str, jobs: list, answers: list, before: list, skipped: list) -> Transferred:
    """Collect the answers of ``jobs`` (child, parent), in that order; ``before`` are history rows that precede them."""
    kind = df.schema[key].dataType.simpleString()
    history = list(before)
    metrics, models = [], {}
    for (child, parent), (model, rounds) in zip(jobs, answers):
        history += [(child, "child", *r) for r in rounds]
        if model is None:
            continue
        models[child] = model
        best = min((r for r in rounds if r[3] is not None), key=lambda r: r[3], default=rounds[-1])
        metrics.append((child, parent, best[3], best[4], len(rounds), rounds[-1][5]))
    schema = f"`{key}` {kind}, parent {kind}, rmse double, r2 double, rounds int, reached boolean"
    return Transferred(
        df.sparkSession.createDataFrame(metrics, schema), models, _history(df, key, history), skipped
    )


def parent_keys(clusters: DataFrame, key: str) -> list:
    """The centres, in order: one model each."""
    return sorted(r[0] for r in cluster_centers_of(clusters, key).select("parent").distinct().collect())


def train_parents(
    df: DataFrame,
    clusters: DataFrame,
    kind: str,
    key: str,
    features: list[str],
    label: str,
    row_id: str | list[str],
    **search,
) -> Trained:
    """Exhaustive training (``kind`` random_forest or gradient_boost) of the centre of every cluster."""
    return EXHAUSTIVE[kind](df, key, features, label, row_id, keys=parent_keys(clusters, key), **search)


def train_children(
    df: DataFrame,
    clusters: DataFrame,
    parents: dict,
    targets: DataFrame,
    kind: str,
    key: str,
    features: list[str],
    label: str,
    row_id: str | list[str],
    start: float | None = None,
    limit: float = FRACTION_LIMIT,
    train_split: float = 0.8,
    seed: int = 1,
    parallelism: int = 4,
) -> Transferred:
    """Train every child with its parent's best settings until it beats its parent's rmse.

    ``parents`` are models by key and ``targets`` their ``(key, rmse, ...)`` rows, from ``train_parents`` or from
    ``load_models`` and ``load_targets``.
    """
    # One pair per model to train; a child of several clusters follows the largest parent key.
    pairs = cluster_members(clusters, key).groupBy("child").agg(F.max("parent").alias("parent")).collect()
    rmse = {r[key]: r["rmse"] for r in targets.collect()}
    trainable = sorted((r["child"], r["parent"]) for r in pairs if r["parent"] in parents and rmse.get(r["parent"]) is not None)
    known = {child for child, _ in trainable}
    skipped = sorted(r["child"] for r in pairs if r["child"] not in known)
    fractions = growing(START_FRACTION[kind] if start is None else start, limit)
    own = [hyper_parameters(parents[parent], kind) for parent in {p for _, p in trainable}]
    known = apart(kind, own, train_split, fractions)
    with training_table(df, key, features, label, row_id, [c for c, _ in trainable], seed, known) as table:
        counts = training_counts(table, key, train_split, fractions)

        def train(pair):
            child, parent = pair
            estimator = estimator_for(kind, hyper_parameters(parents[parent], kind), seed)
            own = counts.get(child, [0] * len(fractions))
            return train_incremental(rows_of(table, key, child), estimator, rmse[parent], fractions, own, train_split)

        answers = fit_each_key(df.sparkSession, trainable, train, parallelism)
    return _transferred(df, key, trainable, answers, [], skipped)


def ensemble(
    df: DataFrame,
    clusters: DataFrame,
    kind: str,
    mode: str,
    directory: str,
    key: str,
    features: list[str],
    label: str,
    row_id: str | list[str],
    **options,
) -> Trained | Transferred:
    """The two halves of the workflow, with the parents kept in ``directory`` in between.

    ``mode="exhaustive"`` trains and saves the parents; ``mode="transfer"`` loads them and trains the children. Children of a
    parent that is not there are listed as skipped.
    """
    if mode == "exhaustive":
        parents = train_parents(df, clusters, kind, key, features, label, row_id, **options)
        save_models(parents.models, parents.metrics, directory)
        return parents
    if mode != "transfer":
        raise ValueError(f"unknown mode {mode!r}, expected 'exhaustive' or 'transfer'")
    spark = df.sparkSession
    models, _ = load_models(spark, parent_keys(clusters, key), directory, kind)
    targets = load_targets(spark, directory)
    return train_children(df, clusters, models, targets, kind, key, features, label, row_id, **options)


def train_from_first(
    df: DataFrame,
    keys: list | str,
    key: str,
    features: list[str],
    label: str,
    row_id: str | list[str],
    start: float = 0.05,
    limit: float = FRACTION_LIMIT,
    seed: int = 1,
    parallelism: int = 4,
    **params,
) -> Transferred:
    """Gradient-boosted trees for the first key on all its rows, then for the others from ``start`` up to its rmse.

    ``keys`` is a list or a comma-separated text.
    """
    wanted = [k.strip() for k in keys.split(",")] if isinstance(keys, str) else list(keys)
    wanted = list(dict.fromkeys(wanted))
    if not wanted:
        raise ValueError("no keys given")
    settings = tree_params("gradient_boost", **{"train_split": 0.9, **params})
    train_split = settings.pop("train_split")
    first, others = wanted[0], wanted[1:]
    estimator = estimator_for("gradient_boost", settings, seed)
    # All rows of the first key come before the growing samples of the others.
    fractions = (1.0, *growing(start, limit))
    with training_table(df, key, features, label, row_id, wanted, seed, apart("gradient_boost", [settings], train_split, fractions)) as table:
        counts = training_counts(table, key, train_split, fractions)
        none = [0] * len(fractions)
        began = time.monotonic()
        answer = fit_and_test(rows_of(table, key, first), estimator, train_split, counts.get(first, none)[0])
        if answer is None or answer[1] is None:
            raise ValueError(f"key {first!r} has too few rows to train on")
        model, rmse, r2 = answer
        answers = fit_each_key(
            df.sparkSession,
            others,
            lambda v: train_incremental(
                rows_of(table, key, v), estimator, rmse, fractions[1:], counts.get(v, none)[1:], train_split
            ),
            parallelism,
        )
    opening = (first, "parent", 0, 1.0, time.monotonic() - began, rmse, r2, True)
    result = _transferred(df, key, [(k, first) for k in others], answers, [opening], [])
    own = df.sparkSession.createDataFrame([(first, first, rmse, r2, 1, True)], result.metrics.schema)
    return replace(result, models={**result.models, first: model}, metrics=own.unionAll(result.metrics))


def train_until(
    df: DataFrame,
    value,
    key: str,
    features: list[str],
    label: str,
    row_id: str | list[str],
    target_rmse: float = 0.7,
    start: float = 0.05,
    limit: float = FRACTION_LIMIT,
    seed: int = 1,
    **params,
) -> Transferred:
    """Gradient-boosted trees for one key on growing samples, until a fixed rmse is reached."""
    settings = tree_params("gradient_boost", **{"train_split": 0.9, **params})
    train_split = settings.pop("train_split")
    estimator = estimator_for("gradient_boost", settings, seed)
    fractions = growing(start, limit)
    with training_table(df, key, features, label, row_id, [value], seed, apart("gradient_boost", [settings], train_split, fractions)) as table:
        own = training_counts(table, key, train_split, fractions).get(value, [0] * len(fractions))
        answer = train_incremental(rows_of(table, key, value), estimator, target_rmse, fractions, own, train_split)
    return _transferred(df, key, [(value, value)], [answer], [], [])
