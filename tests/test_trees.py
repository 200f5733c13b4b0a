import uuid
from pathlib import Path
from urllib.parse import unquote, urlparse

import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from keyspan.functions.sampling import fold_of, sample_fraction, split
from keyspan.functions.scaling import assemble
from keyspan.models import transfer, trees
from keyspan.models.layout import laid_out
from keyspan.models.trees import tree_params
from keyspan.plans import QUERIES

KEY, FEATURES, LABEL = "k", ["x", "z"], "y"


@pytest.fixture(scope="module")
def data(spark):
    """Keys a, b, c with the same shape, ``noise`` without any."""
    rows = [
        (k, i, float(i % 10), float(i % 3), (float((i * 7919) % 101) if k == "noise" else 10.0 * (i % 10 > 4) + (i % 3)))
        for k in ("a", "b", "c", "noise")
        for i in range(2000)
    ]
    rows += [("a", 9999, None, 1.0, 1.0), (None, 1, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "k string, id int, x double, z double, y double")


ARGS = (KEY, FEATURES, LABEL, "id")


def as_dict(df, key="k"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize(
    "train, params", [(trees.random_forest, dict(num_trees=5, max_depth=3)), (trees.gradient_boost, dict(max_iter=3))]
)
def test_fits_repeat_whatever_the_layout(data, train, params):
    first = as_dict(train(data, *ARGS, **params).metrics)
    again = as_dict(train(data.repartition(5), *ARGS, keys=["a", "noise", "absent"], **params).metrics)
    assert set(first) == {"a", "b", "c", "noise"} and set(again) == {"a", "noise"}
    for k in again:
        assert again[k]["rmse"] == pytest.approx(first[k]["rmse"], rel=1e-9)
    assert first["a"]["r2"] > 0.9 > first["noise"]["r2"]


def test_no_features(data):
    with pytest.raises(ValueError):
        trees.random_forest(data, KEY, [], LABEL, "id")


def test_search_takes_the_best_setting(data):
    grid = {"maxDepth": [1, 3]}
    found = trees.random_forest_exhaustive(data, *ARGS, keys=["a"], grid=grid, folds=2, is_bootstrap=False)
    scores = {r["setting"]["maxDepth"]: r["avg_rmse"] for r in found.scores.collect()}
    assert set(scores) == {1.0, 3.0} and scores[3.0] < scores[1.0]
    assert transfer.hyper_parameters(found.models["a"], "random_forest")["maxDepth"] == 3
    assert found.metrics.first()["rmse"] < scores[1.0]


def test_search_on_a_few_rows(spark):
    rows = [("one", 1, 1.0, 1.0, 2.0), ("two", 1, 1.0, 1.0, 2.0), ("two", 2, 2.0, 1.0, 3.0), ("two", 5, 2.0, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, id int, x double, z double, y double")
    found = trees.random_forest_exhaustive(df, *ARGS, grid={"maxDepth": [1, 2]}, folds=3)
    assert set(found.models) <= {"one", "two"} and found.models
    for row in found.scores.where("k = 'one'").collect():
        assert row["avg_rmse"] is None


def test_ties_go_to_the_earlier_setting():
    assert trees.first_best([None, 2.0, 1.0 + 1e-12, 1.0]) == 2
    assert trees.first_best([None, None]) == 0


def test_default_grids():
    assert len(trees.grid_settings(trees.RF_GRID)) == 81 and len(trees.grid_settings(trees.GBT_GRID)) == 27


@pytest.fixture(scope="module")
def clusters(spark):
    rows = [(1, "a", True), (1, "b", False), (1, "noise", False), (2, "gone", True), (2, "c", False)]
    return spark.createDataFrame(rows, "cluster_id int, k string, is_center boolean")


@pytest.mark.parametrize("kind, start", [("random_forest", 0.3), ("gradient_boost", 0.15)])
def test_parents_and_children(data, clusters, kind, start):
    grid = {"maxDepth": [1, 2]}
    size = {} if kind == "random_forest" else {"max_iter": 3}
    parents = transfer.train_parents(data, clusters, kind, *ARGS, grid=grid, folds=2, **size)
    assert set(parents.models) == {"a"}
    target = parents.metrics.first()["rmse"] + 0.5
    targets = parents.metrics.selectExpr("k", "rmse + 0.5 AS rmse")
    children = transfer.train_children(data, clusters, parents.models, targets, kind, *ARGS)
    assert children.skipped == ["c"] and set(children.models) == {"b", "noise"}
    rounds = {}
    for r in children.history.orderBy("round").collect():
        rounds.setdefault(r["k"], []).append(r)
    for k, rows in rounds.items():
        assert [r["fraction"] for r in rows] == [start * 2**i for i in range(len(rows))]
        assert [r["reached"] for r in rows[:-1]] == [False] * (len(rows) - 1)
        last = rows[-1]
        assert (last["rmse"] < target) == last["reached"]
        assert last["reached"] or last["fraction"] * 2 > 0.9
    assert rounds["b"][0]["reached"] and not rounds["noise"][-1]["reached"]
    metrics = as_dict(children.metrics)
    assert metrics["b"]["parent"] == "a" and metrics["noise"]["rounds"] == len(rounds["noise"])
    settings = transfer.hyper_parameters(parents.models["a"], kind)
    assert transfer.hyper_parameters(children.models["b"], kind) == settings


@pytest.mark.parametrize("kind", ["random_forest", "gradient_boost"])
def test_workflow_by_way_of_the_disk(data, clusters, kind, tmp_path):
    size = {"max_depth": 2, "num_trees": 2} if kind == "random_forest" else {"max_depth": 1, "max_iter": 2}
    first = transfer.ensemble(
        data, clusters, kind, "exhaustive", str(tmp_path), *ARGS, grid={"maxBins": [16, 32]}, folds=2, **size
    )
    direct = transfer.train_children(data, clusters, first.models, first.metrics, kind, *ARGS)
    later = transfer.ensemble(data, clusters, kind, "transfer", str(tmp_path), *ARGS)
    assert later.skipped == direct.skipped == ["c"]
    figures = ["k", "round", "fraction", "round(rmse, 9)", "reached"]
    assert sorted(map(tuple, later.history.selectExpr(*figures).collect())) == sorted(
        map(tuple, direct.history.selectExpr(*figures).collect())
    )
    with pytest.raises(ValueError):
        transfer.ensemble(data, clusters, kind, "both", str(tmp_path), *ARGS)


def test_no_rows_at_all(data):
    found = trees.random_forest(data, *ARGS, keys=["absent"])
    assert found.models == {} and found.metrics.count() == 0
    assert trees.gradient_boost(data, *ARGS, keys=[]).metrics.count() == 0


def test_first_key_sets_the_target(data):
    result = transfer.train_from_first(data, "noise, a", *ARGS, max_iter=2, max_depth=1)
    history = result.history.collect()
    assert [(r["k"], r["phase"], r["round"], r["fraction"]) for r in history] == [
        ("noise", "parent", 0, 1.0), ("a", "child", 0, 0.05),
    ]
    assert set(result.models) == {"noise", "a"}
    with pytest.raises(ValueError):
        transfer.train_from_first(data, ["absent", "a"], *ARGS)


def test_fixed_target(data):
    never = transfer.train_until(data, "noise", *ARGS, max_iter=1, max_depth=1)
    assert [r["fraction"] for r in never.history.collect()] == [0.05, 0.1, 0.2, 0.4, 0.8]
    assert not never.metrics.first()["reached"]
    at_once = transfer.train_until(data, "a", *ARGS, target_rmse=100.0, max_iter=1)
    assert at_once.metrics.first()["rounds"] == 1


@pytest.mark.parametrize(
    "kind, name, target, inside, outside",
    [
        ("random_forest", "subsampling_rate", "subsamplingRate", [0.01, 1], [0, 1.01]),
        ("random_forest", "max_depth", "maxDepth", [1], [0]),
        ("random_forest", "max_bins", "maxBins", [1], [0, -3]),
        ("random_forest", "min_info_gain", "minInfoGain", [0.1], [0.0]),
        ("random_forest", "min_instances_per_node", "minInstancesPerNode", [1], [0]),
        ("random_forest", "min_weight_fraction", "minWeightFractionPerNode", [0.0, 0.49], [0.5, -0.1]),
        ("random_forest", "feature_subset_strategy", "featureSubsetStrategy", ["all"], ["", None]),
        ("random_forest", "is_bootstrap", "bootstrap", [True, False], [None]),
        ("gradient_boost", "step_size", "stepSize", [0.1, 1.0], [0.0, 1.1]),
        ("gradient_boost", "max_iter", "maxIter", [1], [0]),
        ("gradient_boost", "loss_type", "lossType", ["absolute"], [""]),
        ("gradient_boost", "impurity", "impurity", ["variance"], [" "]),
    ],
)
def test_tree_rules(kind, name, target, inside, outside):
    for value in inside:
        assert tree_params(kind, **{name: value})[target] == value
    for value in outside:
        assert target not in tree_params(kind, **{name: value})


@pytest.mark.parametrize("kind", ["random_forest", "gradient_boost"])
def test_split_rule(kind):
    assert tree_params(kind, train_split=0.9)["train_split"] == 0.9
    assert tree_params(kind, train_split=1.0)["train_split"] == tree_params(kind)["train_split"] == 0.8
    assert tree_params("random_forest")["numTrees"] == tree_params("random_forest", num_trees=0)["numTrees"] == 1


def jobs_of(spark, run) -> int:
    group = str(uuid.uuid4())
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_few_jobs_per_fit(spark, data):
    one, three = (
        jobs_of(spark, lambda keys=keys: trees.random_forest(data, *ARGS, keys=keys, max_depth=1, num_trees=1)) for keys in (["a"], ["a", "b", "c"])
    )
    assert (three - one) / 2 <= 8
    # Three settings that differ in the number of trees only are one fit a fold.
    grids = ({"maxIter": [3]}, {"maxIter": [1, 2, 3]})
    short, long = (jobs_of(spark, lambda g=g: trees.gradient_boost_exhaustive(data, *ARGS, keys=["a"], grid=g, folds=2, max_depth=1)) for g in grids)
    assert long <= short + 4


def test_stages_are_the_shorter_models(data):
    together = trees.gradient_boost_exhaustive(data, *ARGS, keys=["a"], grid={"maxIter": [1, 3]}, folds=2, max_depth=2)
    scores = {r["setting"]["maxIter"]: r["avg_rmse"] for r in together.scores.collect()}
    for n in (1, 3):
        alone = trees.gradient_boost_exhaustive(data, *ARGS, keys=["a"], grid={"maxIter": [n]}, folds=2, max_depth=2)
        assert alone.scores.first()["avg_rmse"] == pytest.approx(scores[n], rel=1e-9)


def test_draws_do_not_follow_the_session(spark, data):
    rows = data.where("k = 'noise'")
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            found.append(trees.random_forest(rows, *ARGS, num_trees=3, max_depth=2).metrics.first()["rmse"])
            assert laid_out(rows, 50_000, ["id"]).rdd.getNumPartitions() == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_first_key_is_in_the_metrics(data):
    result = transfer.train_from_first(data, "a, b", *ARGS, max_iter=2)
    rows = as_dict(result.metrics)
    assert set(rows) == {"a", "b"} and rows["a"]["parent"] == "a" and rows["a"]["rmse"] is not None


@pytest.mark.parametrize("kind", ["random_forest", "gradient_boost"])
def test_the_grid_of_all_keys_reaches_every_key(spark, small_dir, monkeypatch, kind):
    monkeypatch.setitem(trees.GRIDS, kind, {"maxDepth": [1, 2]})
    found = QUERIES[f"{kind}_whole_grid_all_keys"](spark, small_dir).collect()
    lines = spark.read.parquet(f"{small_dir}/lineitem.parquet").select("l_returnflag", "l_linestatus").distinct().collect()
    assert sorted(map(tuple, found)) == sorted((f"{r[0]}-{r[1]}", 2, 2, 0, True) for r in lines)


def test_cells_are_fitted_like_their_rows(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'a', 'b') as k", "cast(id % 7 as double) as x", "cast(id % 5 as double) as z", "(id % 7) * (id % 5) + (id * 7919 % 101) / 50 as y")
    args = ("k", ["x", "z"], "y", "id")
    clusters = spark.createDataFrame([(1, "a", True), (1, "b", False)], "cluster_id int, k string, is_center boolean")

    def answers():
        found = trees.gradient_boost_exhaustive(rows, *args, grid={"maxIter": [1, 3]}, folds=2, max_depth=2)
        children = transfer.train_children(rows, clusters, found.models, found.metrics, "gradient_boost", *args)
        alone = trees.random_forest(rows, *args, max_depth=3, is_bootstrap=False).metrics
        tables = [found.metrics, found.scores.select("k", "avg_rmse"), alone, children.history.drop("seconds", "phase")]
        return [sorted(map(tuple, t.collect()), key=str) for t in tables]

    one = answers()
    monkeypatch.setattr(trees, "CELL_ROWS", 0)
    known = trees.Apart(0.8, (0.15,), (2,))
    with trees.training_table(rows, *args, known=known) as table:
        # 35 pairs of x and z for two keys, held out or in one of two folds, in the sample or not.
        assert table.count() <= 2 * 35 * 3 * 2 and table.agg(F.sum("_n")).first()[0] == 3000
    for own, other in zip(one, answers()):
        assert len(own) == len(other) > 0
        for a, b in zip(own, other):
            assert [v for v in a if isinstance(v, str)] == [v for v in b if isinstance(v, str)]
            assert [v for v in a if not isinstance(v, str)] == pytest.approx([v for v in b if not isinstance(v, str)], rel=1e-9)


def test_copies_of_rows_are_no_more_to_train_on(data, monkeypatch):
    """The fits from a text of keys work on as many rows however often each is repeated, with the answers of the rows."""
    staged, counts = [], transfer.training_counts
    monkeypatch.setattr(transfer, "training_counts", lambda table, *rest: staged.append(table.count()) or counts(table, *rest))

    def rounds(n):
        copies = data.crossJoin(data.sparkSession.range(n).toDF("copy"))
        found = transfer.train_from_first(copies, "a, b, noise", *ARGS[:3], ["id", "copy"], max_depth=1, max_iter=2)
        return sorted(map(tuple, found.history.drop("seconds").collect()))

    rows = rounds(5)
    monkeypatch.setattr(trees, "CELL_ROWS", 0)
    cells = rounds(5)
    rounds(25)
    assert len(rows) == len(cells) > 5
    for one, other in zip(rows, cells):
        assert one[:4] + one[-1:] == other[:4] + other[-1:] and one[4:6] == pytest.approx(other[4:6], rel=1e-9)
    # 30 pairs of x and z for three keys, held out or not, in the sample of one of five rounds or of none.
    assert staged[0] == 3 * 2000 * 5 and staged[2] <= 3 * 30 * 2 * 6 and staged[2] < 1.2 * staged[1]


def test_rows_that_fits_draw_or_count_are_no_cells():
    assert trees.apart("gradient_boost", [{"maxIter": 2}], 0.8) == trees.Apart(0.8)
    assert trees.apart("random_forest", [{"bootstrap": False}], 0.8) == trees.Apart(0.8)
    for kind, settings in (("random_forest", {}), ("gradient_boost", {"subsamplingRate": 0.5}), ("gradient_boost", {"lossType": "absolute"}), ("gradient_boost", {"minInstancesPerNode": 2})):
        assert trees.apart(kind, [{"bootstrap": False} if settings else {}, settings], 0.8) is None


def test_a_fit_reads_its_own_key_only(data):
    """Files of other keys may be unreadable: a fit does not look at them."""
    with trees.training_table(data, *ARGS) as table:
        files = [Path(unquote(urlparse(f).path)) for f in table.inputFiles()]
        others = [f for f in files if "key=b" not in unquote(f.parent.name)]
        assert 0 < len(others) < len(files)
        for f in others:
            f.write_bytes(b"none")
        rows = trees.rows_of(table, "k", "b").where(trees.below(F.col("_split"), 0.8))
        assert 0 < rows.count() < 2000
        assert {tuple(r["features"]) for r in rows.collect()} == {(float(i % 10), float(i % 3)) for i in range(2000)}


def test_boosted_children_follow_the_whole_grid(spark, tmp_path, monkeypatch):
    """The query's parents are searched by all settings and folds, and its children are fits with the best of them, as plain loops find."""
    rows = [
        ("A", status, i, 1, 1, 1, float(i % 4), float(i // 4 % 3), float(i // 12 % 2), 100.0 * (i % 4) + 30.0 * (i % 4 > 1) * (i // 4 % 3) + i * 7919 % 101)
        for status in ("F", "O")
        for i in range(480)
    ]
    schema = "l_returnflag string, l_linestatus string, l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, l_extendedprice double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    found, train = [], transfer.train_parents
    monkeypatch.setattr(transfer, "train_parents", lambda *args, **search: found.append(train(*args, **search)) or found[0])
    history = QUERIES["gradient_boost_transfer"](spark, str(tmp_path)).orderBy("round").collect()
    scores = {tuple(r["setting"][n] for n in trees.GBT_GRID): r["avg_rmse"] for r in found[0].scores.where("line_kind = 'A-F'").collect()}
    assert set(scores) == {tuple(map(float, s.values())) for s in trees.grid_settings(trees.GBT_GRID)} and None not in scores.values()

    line_id, features = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    lines = spark.read.parquet(str(tmp_path / "lineitem.parquet")).withColumn("label", F.col("l_extendedprice"))
    lines = assemble(lines, features).cache()

    def rmse(train, test, setting):
        bins, depth, steps = map(int, setting)
        model = GBTRegressor(featuresCol="features", labelCol="label", seed=1, maxBins=bins, maxDepth=depth, maxIter=steps).fit(train)
        return RegressionEvaluator(labelCol="label", metricName="rmse").evaluate(model.transform(test))

    train, held_out = split(lines.where("l_linestatus = 'F'"), 0.8, line_id)
    folds = [(train.where(fold_of(line_id, 3) != f), train.where(fold_of(line_id, 3) == f)) for f in range(3)]
    assert sum(rmse(*fold, (50, 4, 15)) for fold in folds) / 3 == pytest.approx(scores[50.0, 4.0, 15.0], rel=1e-6)
    best = next(s for s in (tuple(map(float, s.values())) for s in trees.grid_settings(trees.GBT_GRID)) if scores[s] <= min(scores.values()) * (1 + 1e-9))
    target = rmse(train, held_out, best)
    assert [r["fraction"] for r in history] == [0.15, 0.3, 0.6][: len(history)] and {r["line_kind"] for r in history} == {"A-O"}
    for r in history:
        own = rmse(*split(sample_fraction(lines.where("l_linestatus = 'O'"), r["fraction"], line_id), 0.8, line_id), best)
        assert r["rmse"] == pytest.approx(own, rel=1e-6) and r["reached"] == (own < target)
    assert len(history) == 3 or history[-1]["reached"]
