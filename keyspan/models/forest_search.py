"""Grid search, transfer and saved models on trees grown together (``forests``): all keys in the same jobs, models as rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.models.forests import Grown, Settings, grow, ready
from keyspan.models.transfer import FRACTION_LIMIT, START_FRACTION, growing
from keyspan.models.trees import GRIDS, TIE, grid_settings, tree_params
from keyspan.operators.frames import quoted
from keyspan.operators.summaries import cluster_centers_of, cluster_members
from keyspan.sources.storage import path_exists, written

# What a longer or deeper ensemble of the same kind answers as well.
PART_OF = {"random_forest": "maxDepth", "gradient_boost": "maxIter"}


@dataclass
class Models:
    """``nodes`` (a row per node of every key's trees), ``metrics (key, rmse, r2)``, ``chosen (key, setting)`` with all numbers the trees
    were grown with, and ``scores (key, setting, avg_rmse)`` of a search's grid."""

    nodes: DataFrame
    metrics: DataFrame
    chosen: DataFrame
    scores: DataFrame | None = None


def _params(kind: str, raw: dict) -> dict:
    return tree_params(kind, **raw)


def train_together(
    kind: str,
    df: DataFrame,
    key: str,
    features: list[str],
    label: str,
    row_id: str | list[str],
    keys: list | DataFrame | None = None,
    seed: int = 1,
    **params,
) -> Models:
    """One ensemble per key, ``kind`` random_forest or gradient_boost, tested on the rows held out by ``train_split``."""
    own = _params(kind, params)
    found = grow(df, key, features, label, row_id, [Settings.of(kind, own, seed=seed)], keys, seed)
    chosen = found.nodes.select(quoted(key)).distinct().withColumn("setting", _literal(_numbers(own)))
    return Models(found.nodes.drop("task"), _accuracy(found, key), chosen)


def _accuracy(found: Grown, key: str) -> DataFrame:
    """Every key that has trees; without held-out rows its figures are null."""
    return found.nodes.select(quoted(key)).distinct().join(found.errors.select(quoted(key), "rmse", "r2"), key, "left")


def _numbers(params: dict) -> dict:
    return {name: float(v) for name, v in params.items() if isinstance(v, (int, float))}


def _literal(numbers: dict) -> Column:
    if not numbers:
        return F.create_map().cast("map<string,double>")
    return F.create_map(*[c for name, v in numbers.items() for c in (F.lit(name), F.lit(float(v)))])


def search_together(
    kind: str,
    df: DataFrame,
    key: str,
    features: list[str],
    label: str,
    row_id: str | list[str],
    keys: list | DataFrame | None = None,
    grid: dict | None = None,
    folds: int = 3,
    seed: int = 1,
    **params,
) -> Models:
    """The best setting of a grid for every key, by cross-validation, and its ensemble on all training rows.

    Settings that differ in depth (forests) or in steps (boosting) only are one ensemble. Those for all training rows are grown
    beside the folds, so the best one is there when the scores are.
    """
    base = _params(kind, params)
    settings = grid_settings(GRIDS[kind] if grid is None else grid)
    shared: dict[tuple, list[int]] = {}
    for i, setting in enumerate(settings):
        shared.setdefault(tuple(sorted((n, v) for n, v in setting.items() if n != PART_OF[kind])), []).append(i)
    tasks, depths, stages, places = [], {}, {}, []
    for which in shared.values():
        most = max(which, key=lambda i: settings[i].get(PART_OF[kind], 0))
        for fold in (-1, *range(folds)):
            own = Settings.of(kind, {**base, **settings[most]}, folds=folds, fold=fold, seed=seed)
            each = [Settings.of(kind, {**base, **settings[i]}) for i in which]
            depths[len(tasks)], stages[len(tasks)] = sorted({s.max_depth for s in each}), sorted({s.trees for s in each})
            places += [(len(tasks), s.max_depth, s.trees, i, fold) for s, i in zip(each, which)]
            tasks.append(own)
    found = grow(df, key, features, label, row_id, tasks, keys, seed, depths, stages)
    spark = df.sparkSession
    place = F.broadcast(spark.createDataFrame(places, "task int, depth int, stage int, setting_no int, fold int"))
    errors = found.errors.join(place, ["task", "depth", "stage"])
    known = found.nodes.select(quoted(key)).distinct()
    listed = known.select(quoted(key), F.posexplode(F.array(*[_literal(s) for s in settings])).alias("setting_no", "setting"))
    means = errors.where("fold >= 0").groupBy(quoted(key), "setting_no").agg(F.avg("rmse").alias("avg_rmse"))
    scores = written(listed.join(means, [key, "setting_no"], "left"))
    each = F.sort_array(F.collect_list(F.struct("setting_no", "avg_rmse")))
    best = scores.groupBy(quoted(key)).agg(F.min("avg_rmse").alias("least"), each.alias("all"))
    near = F.filter("all", lambda s: s["avg_rmse"] <= F.col("least") * (1 + TIE))
    best = best.select(quoted(key), F.coalesce(F.get(near, F.lit(0))["setting_no"], F.lit(0)).alias("setting_no"))
    left_alone = _literal({n: v for n, v in _numbers(base).items() if n not in settings[0]})
    own = F.array(*[_literal(s) for s in settings])[F.col("setting_no")]
    chosen = written(best.select(quoted(key), "setting_no", F.map_concat(left_alone, own).alias("setting")))
    final = errors.where("fold = -1").select(quoted(key), "setting_no", "rmse", "r2")
    metrics = chosen.join(final, [key, "setting_no"], "left").select(quoted(key), "rmse", "r2")
    own = chosen.join(place.where("fold = -1"), "setting_no").select(quoted(key), "task", "depth", "stage")
    nodes = found.nodes.join(own, [key, "task"])
    if kind == "gradient_boost":
        nodes = nodes.where(F.col("tree") < F.col("stage"))
    else:
        # The upper part of the deepest: what stands at the chosen depth is a leaf.
        nodes = nodes.where(F.col("level") <= F.col("depth")).withColumn("feature", F.when(F.col("level") < F.col("depth"), F.col("feature")).otherwise(-1))
    return Models(written(nodes.drop("task", "depth", "stage")), written(metrics), chosen.drop("setting_no"), scores.drop("setting_no"))


def parents_together(df: DataFrame, clusters: DataFrame, kind: str, key: str, features: list[str], label: str, row_id, **search) -> Models:
    """``search_together`` for the centre of every cluster."""
    centers = cluster_centers_of(clusters, key).select(F.col("parent").alias(key)).distinct()
    return search_together(kind, df, key, features, label, row_id, keys=centers, **search)


# Models as rows


def save_together(models: Models, directory: str) -> None:
    """Any number of keys in three writes."""
    models.nodes.write.mode("overwrite").parquet(f"{directory}/nodes")
    models.metrics.write.mode("overwrite").parquet(f"{directory}/metrics")
    models.chosen.write.mode("overwrite").parquet(f"{directory}/chosen")


def load_together(spark: SparkSession, directory: str) -> Models:
    return Models(*(spark.read.parquet(f"{directory}/{name}") for name in ("nodes", "metrics", "chosen")))


# Children


def children_together(
    df: DataFrame,
    clusters: DataFrame,
    parents: Models,
    kind: str,
    key: str,
    features: list[str],
    label: str,
    row_id: str | list[str],
    directory: str,
    start: float | None = None,
    limit: float = FRACTION_LIMIT,
    seed: int = 1,
    most_rounds: int | None = None,
    **params,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every child with its parent's settings, on growing samples until it beats its parent's rmse.

    All children still open are one call of ``grow`` per round, on rows that the first round of a call makes ready for all of them. A round ends with its table in ``directory``, ``rounds/n`` (key, parent,
    fraction, rmse, r2, reached) and ``nodes/n``; a call that finds rounds there goes on after them, so a lost driver costs one round.
    ``most_rounds`` stops earlier. Returns the history, the nodes of each child's best round, and the children whose parent has no model.
    """
    spark = df.sparkSession
    base = _params(kind, params)
    fractions = growing(START_FRACTION[kind] if start is None else start, limit)
    known = parents.chosen.join(parents.metrics.select(quoted(key), "rmse"), key).where("rmse IS NOT NULL")
    # As many different settings as a grid has.
    names = F.array_sort(F.map_entries("setting")).alias("names")
    settings = sorted(tuple((e["key"], e["value"]) for e in r["names"]) for r in known.select(names).distinct().collect())
    numbered = spark.createDataFrame(list(enumerate(map(dict, settings))), "task int, setting map<string,double>").select("task", names)
    pairs = cluster_members(clusters, key).groupBy("child").agg(F.max("parent").alias("parent"))
    wanted = known.select(quoted(key).alias("parent"), F.col("rmse").alias("target"), names).join(F.broadcast(numbered), "names").drop("names")
    open_children = pairs.join(wanted, "parent").select(F.col("child").alias(key), "parent", "target", "task")
    skipped = pairs.join(known.select(quoted(key).alias("parent")), "parent", "left_anti").select(F.col("child").alias(key))
    rounds = [[Settings.of(kind, {**base, **_typed(dict(s))}, fraction=f, seed=seed) for s in settings] for f in fractions[:most_rounds]]
    done, packed = [], None
    for number, (fraction, own) in enumerate(zip(fractions, rounds)):
        place = f"{directory}/rounds/{number}"
        if not path_exists(spark, f"{place}/_SUCCESS"):
            if open_children.isEmpty():
                break
            if packed is None:
                to_come = [s for tasks in rounds[number:] for s in tasks]
                packed = ready(df, key, features, label, row_id, to_come, open_children.select(quoted(key)), seed)
            found = grow(df, key, features, label, row_id, own, seed=seed, which=open_children.select(quoted(key), "task"), known=packed)
            found.nodes.write.mode("overwrite").parquet(f"{directory}/nodes/{number}")
            # The round counts once this table is whole.
            judged = open_children.join(found.errors.select(quoted(key), "task", "rmse", "r2"), [key, "task"], "left")
            judged = judged.withColumns({"reached": F.coalesce(F.col("rmse") < F.col("target"), F.lit(False)), "round": F.lit(number), "fraction": F.lit(fraction)})
            judged.write.mode("overwrite").parquet(place)
        judged = spark.read.parquet(place)
        done.append(number)
        open_children = judged.where(~F.col("reached")).select(quoted(key), "parent", "target", "task")
    history = spark.read.parquet(*[f"{directory}/rounds/{n}" for n in done]) if done else None
    if history is None:
        kind_of = df.schema[key].dataType.simpleString()
        empty = spark.createDataFrame([], f"`{key}` {kind_of}, parent {kind_of}, round int, fraction double, rmse double, r2 double, reached boolean")
        return empty, parents.nodes.limit(0), skipped
    best = history.groupBy(quoted(key)).agg(F.min_by("round", F.struct(F.col("rmse").isNull(), "rmse", "round")).alias("round"))
    nodes = spark.read.parquet(f"{directory}/nodes/{done[0]}").withColumn("round", F.lit(done[0]))
    for n in done[1:]:
        nodes = nodes.unionByName(spark.read.parquet(f"{directory}/nodes/{n}").withColumn("round", F.lit(n)))
    columns = [key, "parent", "round", "fraction", "rmse", "r2", "reached"]
    return history.select(*map(quoted, columns)), nodes.join(best, [key, "round"]).drop("round", "task"), skipped


WHOLE = ("maxBins", "maxDepth", "maxIter", "numTrees", "minInstancesPerNode")


def _typed(setting: dict) -> dict:
    """A setting read back from a map of doubles."""
    return {n: int(v) if n in WHOLE else bool(v) if n == "bootstrap" else v for n, v in setting.items()}
