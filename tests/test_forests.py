"""Trees of all keys grown together, against Spark ML and against plain loops."""

import math
import random

import checking
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F

from keyspan.functions.scaling import assemble
from keyspan.models import forest_search, forests, trees
from keyspan.models.forests import Settings, Sketch, grow, predicted
from keyspan.models.trees import rows_of_keys
from keyspan.plans import ORACLES, QUERIES

ARGS = ("k", ["x", "z"], "y", "id")


@pytest.fixture(scope="module")
def data(spark):
    draw = random.Random(1)
    rows = []
    for k, scale in (("a", 1.0), ("b", 50.0), ("", 3.0)):
        for i in range(600):
            x, z = draw.randrange(23), draw.randrange(11) / 4
            rows.append((k, i, float(x), z, scale * (7.0 * (x > 9) + 3.0 * (z > 1.1) * (x < 4)) + draw.random()))
    rows += [("a", 9999, None, 1.0, 1.0), ("a", 9998, float("nan"), 1.0, 1.0), (None, 1, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "k string, id int, x double, z double, y double")


def as_dict(df, *columns):
    return {r["k"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


@pytest.mark.parametrize("depth, params", [(2, {}), (4, {"min_instances_per_node": 12, "min_weight_fraction": 0.05})])
def test_one_tree_is_that_of_spark_ml(data, depth, params):
    found = forest_search.train_together("random_forest", data, *ARGS, max_depth=depth, is_bootstrap=False, **params)
    names = {"min_instances_per_node": "minInstancesPerNode", "min_weight_fraction": "minWeightFractionPerNode"}
    with trees.training_table(data, *ARGS) as table:
        for k in ("a", "b", ""):
            train = trees.rows_of(table, "k", k).where(trees.below(F.col("_split"), 0.8))
            model = DecisionTreeRegressor(maxDepth=depth, **{names[n]: v for n, v in params.items()}).fit(train)
            own = predicted(data.where(F.col("k") == k), found.nodes, "k", ["x", "z"])
            pairs = model.setPredictionCol("theirs").transform(assemble(own.where("x IS NOT NULL AND NOT isnan(x)"), ["x", "z"]))
            worst = pairs.agg(F.max(F.abs(F.col("prediction") - F.col("theirs")))).first()[0]
            assert worst < 1e-9, (k, model.toDebugString)
            assert found.nodes.where((F.col("k") == k) & (F.col("feature") >= 0)).count() == (model.numNodes - 1) // 2


def test_boosting_is_that_of_spark_ml(data):
    found = forest_search.train_together("gradient_boost", data, *ARGS, max_iter=4, max_depth=2, step_size=0.3)
    with trees.training_table(data, *ARGS) as table:
        train = trees.rows_of(table, "k", "b").where(trees.below(F.col("_split"), 0.8))
        model = GBTRegressor(maxIter=4, maxDepth=2, stepSize=0.3).fit(train).setPredictionCol("theirs")
        own = predicted(data.where("k = 'b'"), found.nodes, "k", ["x", "z"])
        worst = model.transform(assemble(own, ["x", "z"])).agg(F.max(F.abs(F.col("prediction") - F.col("theirs")))).first()[0]
    assert worst < 1e-8


def test_accuracy_is_that_of_the_predictions(data):
    found = forest_search.train_together("random_forest", data, *ARGS, num_trees=5, max_depth=3)
    test = trees.below(forests.id_hash("id", "split", 1), 0.8)
    rows = predicted(data.where(~test), found.nodes, "k", ["x", "z"]).where("prediction IS NOT NULL")
    want = as_dict(rows.groupBy("k").agg(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2)).alias("rmse")), "rmse")
    got = as_dict(found.metrics, "rmse", "r2")
    assert set(got) == {"a", "b", ""} and all(got[k][0] == pytest.approx(want[k], rel=1e-9) and got[k][1] > 0.8 for k in got)
    assert {r["tree"] for r in found.nodes.select("tree").collect()} == set(range(5))
    again = forest_search.train_together("random_forest", data.repartition(7), *ARGS, keys=["a", "gone"], num_trees=5, max_depth=3)
    assert as_dict(again.metrics, "rmse") == {"a": pytest.approx(got["a"][0], rel=1e-9)}
    missing = predicted(data.where("x IS NULL OR isnan(x) OR k IS NULL"), found.nodes, "k", ["x", "z"]).collect()
    assert len(missing) == 3 and all(r["prediction"] is None for r in missing)


def test_search_is_every_setting_grown_alone(data):
    grid = {"maxDepth": [1, 3], "minWeightFractionPerNode": [0.1, 0.4]}
    found = forest_search.search_together("random_forest", data, *ARGS, grid=grid, folds=2, is_bootstrap=False)
    scores = {(r["k"], r["setting"]["maxDepth"], r["setting"]["minWeightFractionPerNode"]): r["avg_rmse"] for r in found.scores.collect()}
    assert len(scores) == 12
    for depth, share in ((1, 0.4), (3, 0.1)):
        tasks = [Settings(max_depth=depth, min_weight=share, bootstrap=False, folds=2, fold=f) for f in (0, 1)]
        alone = grow(data, *ARGS, tasks)
        mean = as_dict(alone.errors.groupBy("k").agg(F.avg("rmse").alias("rmse")), "rmse")
        assert all(scores[k, depth, share] == pytest.approx(mean[k], rel=1e-12) for k in mean)
    chosen = as_dict(found.chosen, "setting")
    for k in ("a", "b", ""):
        best = min((s, d, w) for (own, d, w), s in scores.items() if own == k)
        assert scores[k, chosen[k]["maxDepth"], chosen[k]["minWeightFractionPerNode"]] <= best[0] * (1 + trees.TIE)
        assert chosen[k]["bootstrap"] == 0.0
    final = grow(data, *ARGS, [Settings(max_depth=int(chosen["a"]["maxDepth"]), min_weight=chosen["a"]["minWeightFractionPerNode"], bootstrap=False)], keys=["a"])
    columns = ["tree", "node", "feature", "value"]
    assert sorted(map(tuple, final.nodes.select(columns).collect())) == sorted(map(tuple, found.nodes.where("k = 'a'").select(columns).collect()))


def test_boosting_stages_are_shorter_ensembles(data):
    found = forest_search.search_together("gradient_boost", data, *ARGS, keys=["a"], grid={"maxIter": [1, 3], "maxDepth": [1, 2]}, folds=2)
    scores = {(r["setting"]["maxIter"], r["setting"]["maxDepth"]): r["avg_rmse"] for r in found.scores.collect()}
    for n, depth in ((1, 2), (3, 1)):
        score = scores[n, depth]
        alone = grow(data, *ARGS, [Settings(boosted=True, trees=int(n), max_depth=int(depth), bootstrap=False, subset="all", folds=2, fold=f) for f in (0, 1)], keys=["a"])
        assert score == pytest.approx(alone.errors.agg(F.avg("rmse")).first()[0], rel=1e-12)


def test_few_rows_and_none(spark, data):
    rows = [("one", 1, 1.0, 1.0, 2.0), ("two", 1, 1.0, 1.0, 2.0), ("two", 2, 2.0, 1.0, 3.0), ("two", 5, 2.0, 1.0, 3.0), ("flat", 7, 1.0, 1.0, 5.0), ("flat", 8, 2.0, 2.0, 5.0)]
    df = spark.createDataFrame(rows, "k string, id int, x double, z double, y double")
    found = forest_search.search_together("random_forest", df, *ARGS, grid={"maxDepth": [1, 2]}, folds=3)
    assert {r["k"] for r in found.metrics.collect()} <= {"one", "two", "flat"}
    assert all(r["avg_rmse"] is None for r in found.scores.where("k = 'one'").collect())
    nothing = forest_search.train_together("gradient_boost", data.limit(0), *ARGS, max_iter=2)
    assert nothing.metrics.collect() == [] and nothing.nodes.collect() == []
    for wrong in ({"impurity": "gini"}, {"lossType": "absolute"}):
        with pytest.raises(ValueError):
            Settings.of("gradient_boost", wrong)
    with pytest.raises(ValueError):
        grow(data, "k", [], "y", "id", [Settings()])
    with pytest.raises(ValueError):
        grow(data, *ARGS, [Settings(), Settings(boosted=True)])


@pytest.mark.parametrize("params", [dict(boosted=True, trees=3, max_depth=2, bootstrap=False, subset="all"), dict(trees=3, max_depth=3, rate=0.7)])
def test_large_keys_are_grown_level_by_level_alike(data, monkeypatch, params):
    tasks = [Settings(folds=2, fold=f, max_bins=b, **params) for f in (-1, 0) for b in (4, 32)]
    want = {"depths": {0: [1, 3]}, "stages": {1: [1, 3]}}
    alone = grow(data, *ARGS, tasks, **want)
    # Blocks of few rows; one key is small, two are large.
    monkeypatch.setattr(forests, "BLOCK", 100)
    monkeypatch.setattr(forests, "ALONE_VALUES", 0)
    levels = grow(data, *ARGS, tasks, **want)
    columns = ["k", "task", "tree", "node", "feature", "threshold", "child", "level"]
    assert sorted(map(tuple, alone.nodes.select(columns).collect()), key=str) == sorted(map(tuple, levels.nodes.select(columns).collect()), key=str)
    by = ["k", "task", "depth", "stage"]
    one, other = ({tuple(r[c] for c in by): (r["n"], r["rmse"]) for r in g.errors.collect()} for g in (alone, levels))
    assert set(one) == set(other) and all(one[k][0] == other[k][0] and one[k][1] == pytest.approx(other[k][1], rel=1e-9) for k in one)


def test_jobs_do_not_depend_on_keys(spark, monkeypatch):
    monkeypatch.setattr(forests, "ALONE_VALUES", 0)

    def jobs(n):
        rows = spark.range(400 * n).selectExpr("id", "cast(id % {} as string) as k".format(n), "id % 13 * 1.0 as x", "id % 5 * 1.0 as z", "id % 17 * 1.0 as y")
        spark.sparkContext.setJobGroup(f"forest-{n}", "")
        forest_search.train_together("random_forest", rows, *ARGS, max_depth=2).metrics.count()
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest-{n}"))

    assert abs(jobs(40) - jobs(2)) <= 2


def test_sketch():
    draw = np.random.default_rng(1)
    few = Sketch(*np.unique([3.0, 1.0, 1.0, 2.0], return_counts=True))
    assert few.cuts(32).tolist() == [1.5, 2.5] and few.cuts(2).tolist() == [1.5]
    whole, parts = draw.normal(size=60_000), Sketch(np.array([]), np.array([]))
    for part in np.split(whole, 30):
        parts = parts.plus(Sketch(*np.unique(part, return_counts=True)))
    assert not parts.exact and len(parts.values) <= forests.SKETCH and parts.counts.sum() == 60_000
    cuts = parts.cuts(10)
    assert len(cuts) == 9 and np.abs(np.searchsorted(np.sort(whole), cuts) / 6000 - np.arange(1, 10)).max() < 0.05
    # A value that most rows have does not use up the bins of the others.
    heavy = Sketch(np.arange(100.0), np.array([10_000.0] + [1.0] * 99))
    assert 1 <= len(heavy.cuts(10)) <= 9


def test_draws():
    draws = np.random.default_rng(2).integers(0, 2**32, size=(3, 200_000))
    drawn = forests._times(draws, Settings(rate=0.5), 3)
    for n in range(4):
        assert abs((drawn == n).mean() - math.exp(-0.5) * 0.5**n / math.factorial(n)) < 0.004
    other = forests._times(draws, Settings(rate=0.5), 4)
    assert abs(np.corrcoef(drawn, other)[0, 1]) < 0.01
    assert abs(forests._times(draws, Settings(rate=0.3, bootstrap=False), 0).mean() - 0.3) < 0.004
    assert (forests._times(draws, Settings(bootstrap=False), 0) == 1).all()
    assert [Settings(subset=s, trees=3).features_per_node(10) for s in ("auto", "all", "sqrt", "log2", "0.25", "4")] == [4, 10, 4, 4, 3, 4]


@pytest.fixture(scope="module")
def clusters(spark):
    return spark.createDataFrame([(1, "a", True), (1, "b", False), (1, "", False), (2, "gone", True), (2, "c", False)], "cluster_id int, k string, is_center boolean")


def test_rounds_go_on_where_they_stopped(spark, data, clusters, tmp_path):
    kind = "random_forest"
    parents = forest_search.parents_together(data, clusters, kind, *ARGS, grid={"maxDepth": [1, 2]}, folds=2)
    forest_search.save_together(parents, str(tmp_path / "saved"))
    loaded = forest_search.load_together(spark, str(tmp_path / "saved"))
    assert sorted(loaded.nodes.collect()) == sorted(parents.nodes.collect())
    run = lambda folder, **more: forest_search.children_together(data, clusters, loaded, kind, *ARGS, str(tmp_path / folder), **more)
    history, nodes, skipped = run("whole")
    whole = sorted(map(tuple, history.collect()), key=str)
    assert [r["k"] for r in skipped.collect()] == ["c"] and {r[0] for r in whole} == {"b", ""}
    assert {r["k"] for r in nodes.select("k").collect()} == {"b", ""}
    rounds = {k: [r for r in whole if r[0] == k] for k in ("b", "")}
    for rows in rounds.values():
        assert [r[2] for r in rows] == list(range(len(rows))) and not any(r[6] for r in rows[:-1])
    # Stopped after one round, then called again; a round without its mark is done anew.
    first = run("parts", most_rounds=1)[0]
    assert {r["round"] for r in first.collect()} == {0}
    assert sorted(map(tuple, run("parts")[0].collect()), key=str) == whole
    assert sorted(map(tuple, run("parts")[0].collect()), key=str) == whole


@pytest.mark.parametrize("params", [dict(boosted=True, trees=3, max_depth=2, bootstrap=False, subset="all"), dict(boosted=True, trees=2, max_depth=2, bootstrap=False, rate=0.6, subset="all"), dict(trees=3, max_depth=3, rate=0.7)])
@pytest.mark.parametrize("alone", [forests.ALONE_VALUES, 0])
def test_cells_grow_the_trees_of_their_rows(data, monkeypatch, params, alone):
    tasks = [Settings(folds=3, fold=f, max_bins=b, fraction=share, **params) for f, b, share in ((-1, 4, 1.0), (0, 32, 1.0), (-1, 32, 0.5))]
    want = {"depths": {0: [1, params["max_depth"]]}, "stages": {1: [1, params["trees"]]}}
    rows = grow(data, *ARGS, tasks, **want)
    monkeypatch.setattr(forests, "CELL_ROWS", 0)
    monkeypatch.setattr(forests, "ALONE_VALUES", alone)
    cells = grow(data, *ARGS, tasks, **want)
    columns = ["k", "task", "tree", "node", "feature", "threshold", "child", "level"]
    assert sorted(map(tuple, cells.nodes.select(columns).collect()), key=str) == sorted(map(tuple, rows.nodes.select(columns).collect()), key=str)
    by = ["k", "task", "depth", "stage"]
    one, other = ({tuple(r[c] for c in by): (r["n"], r["rmse"], r["r2"]) for r in g.errors.collect()} for g in (cells, rows))
    assert set(one) == set(other) and all(one[k] == pytest.approx(other[k], rel=1e-9) for k in one)


def test_copies_of_rows_are_no_more_to_grow(data, monkeypatch):
    monkeypatch.setattr(forests, "CELL_ROWS", 0)
    tasks = [Settings(bootstrap=False, folds=3, fold=f) for f in (-1, 0, 1, 2)]
    cells = [forests.pack(data.crossJoin(data.sparkSession.range(n).toDF("copy")), *ARGS[:3], ["id", "copy"], tasks=tasks).agg(F.sum("n")).first()[0] for n in (20, 100)]
    # 253 pairs of x and z for three keys, held out or in one of three folds.
    assert all(n <= 3 * 253 * 4 for n in cells) and cells[1] < 1.2 * cells[0]


def test_rounds_share_one_pass_over_the_rows(data, clusters, tmp_path, monkeypatch):
    parents = forest_search.parents_together(data, clusters, "gradient_boost", *ARGS, grid={"maxIter": [1, 2]}, folds=2)
    # Nobody gets there, so all rounds are gone through.
    parents.metrics = parents.metrics.withColumn("rmse", F.lit(0.0))
    packs, pack = [], forests.pack
    monkeypatch.setattr(forests, "pack", lambda *args: packs.append(args) or pack(*args))
    monkeypatch.setattr(forests, "CELL_ROWS", 0)
    history, _, _ = forest_search.children_together(data, clusters, parents, "gradient_boost", *ARGS, str(tmp_path))
    assert len(packs) == 1 and history.select("round").distinct().count() == 3
    settings = {r["k"]: forest_search._typed(r["setting"]) for r in parents.chosen.collect()}
    for r in history.where("k IN ('b', '')").collect():
        own = Settings.of("gradient_boost", settings["a"], fraction=r["fraction"])
        alone = grow(data, *ARGS, [own], [r["k"]]).errors.first()
        assert (r["rmse"], r["r2"]) == pytest.approx((alone["rmse"], alone["r2"]), rel=1e-9)


def test_rows_stay_where_they_are_for_few_keys(spark, data):
    few = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")
    plan = rows_of_keys(data.repartition(3), "k", few)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert rows_of_keys(data, "k", few).count() == data.where("k IN ('a', 'b')").count()


def test_children_follow_the_whole_grid(spark, tmp_path, monkeypatch):
    """The query's parents are searched by all settings and folds, and SQL, which goes through all of them, finds the same rounds."""
    draw = random.Random(3)
    rows = []
    for i in range(1800):
        flag, status, quantity, discount, tax = "ANR"[i % 3], "FO"[i // 3 % 2], draw.randrange(64), draw.randrange(11) / 100, draw.randrange(9) / 100
        price = 900.0 * (quantity > 40) + 400.0 * (discount > 0.06) * (quantity < 20) + 150.0 * (tax > 0.03) + 500 * draw.random() + 100 * (flag == "N") * (status == "O") * draw.random()
        rows.append({"l_orderkey": i, "l_linenumber": i % 7, "l_partkey": i % 11, "l_suppkey": 1, "l_returnflag": flag, "l_linestatus": status, "l_quantity": float(quantity), "l_discount": discount, "l_tax": tax, "l_extendedprice": price})
    # Rows that come twice, and rows without a quantity, a part of their id or a part of their key.
    rows += rows[:40] + [{**row, "l_orderkey": 9000 + i, name: None} for i, (row, name) in enumerate((r, n) for r in rows[40:60] for n in ("l_quantity", "l_partkey", "l_linestatus", "l_returnflag"))]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "lineitem.parquet")
    found, search = [], forest_search.parents_together
    monkeypatch.setattr(forest_search, "parents_together", lambda *args, **more: found.append(search(*args, **more)) or found[0])
    answer = checking.spark_rows(QUERIES["random_forest_children_together"](spark, str(tmp_path)))
    grid = {tuple(map(float, s.values())) for s in trees.grid_settings(trees.RF_GRID)}
    scores = found[0].scores.collect()
    assert len(scores) == 3 * 81 and all(r["avg_rmse"] is not None for r in scores)
    for kind in ("A-F", "N-F", "R-F"):
        assert {tuple(r["setting"][n] for n in trees.RF_GRID) for r in scores if r["line_kind"] == kind} == grid
    assert answer == checking.duck_rows(checking.connect(str(tmp_path)), ORACLES["random_forest_children_together"])
    assert len(answer[1]) >= 3
