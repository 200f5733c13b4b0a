from types import SimpleNamespace

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keyspan.sources import load_models, load_stats, load_table, save_models, shared_dir, staged_by_key, to_json_rows, written
from keyspan.operators.windows import moving_average
from keyspan.sources.models import load_targets
from keyspan.sources.storage import rows_with_key, scratch
from keyspan.sources.tables import from_json_rows, stats_table
from keyspan.models import trees


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    df.write.json(f"{tmp_path}/t.json")
    df.write.csv(f"{tmp_path}/t.csv", header=True)
    df.write.parquet(f"{tmp_path}/t.parquet")
    for fmt, options in (("json", {}), ("csv", {"header": "true"}), ("parquet", {})):
        got = load_table(spark, str(tmp_path), "t", fmt, schema="id int, v string", options=options)
        assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, None)]
    assert load_table(spark, str(tmp_path), "t.parquet", suffix="").count() == 2


def test_connector_without_directory(spark):
    got = load_table(spark, None, "ignored", options={"path": "/root/testdata/sf0.001/nation.parquet"})
    assert got.count() == 25


def test_resolutions(spark, tmp_path):
    assert [stats_table(r) for r in ("State", "County", "TRACT", "block")] == [
        "state_stats", "county_stats", "tract_stats", "block_stats",
    ]
    with pytest.raises(ValueError):
        stats_table("city")
    spark.range(3).write.parquet(f"{tmp_path}/county_stats.parquet")
    spark.range(4).write.parquet(f"{tmp_path}/other.parquet")
    assert load_stats(spark, str(tmp_path), "County").count() == 3
    assert load_stats(spark, str(tmp_path), "County", table="other").count() == 4


def test_json_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None, 0.0)], "a int, b string, c double")
    assert to_json_rows(df).first()["json"] == '{"a":1,"b":null,"c":0.0}'


@pytest.mark.parametrize("schema", ["a int, b string", StructType().add("a", "integer").add("b", "string")])
def test_broken_documents_are_named(spark, schema):
    documents = ['{"a":1,"b":"x"}', '{"b":"y"}', '{"a":', '{"a":"no number","b":"z"}', "", None]
    df = spark.createDataFrame([(d,) for d in documents], "`a.json` string")
    plain = [tuple(r) for r in from_json_rows(df, schema, "a.json").collect()]
    assert plain[:3] == [(1, "x"), (None, "y"), (None, None)]
    marked = from_json_rows(df, schema, "a.json", broken="text").collect()
    assert [tuple(r)[:2] for r in marked] == plain
    assert [r["text"] for r in marked] == [None, None, '{"a":', '{"a":"no number","b":"z"}', None, None]
    with pytest.raises(ValueError):
        from_json_rows(df, schema, "a.json", broken="b")


def test_shared_dir_is_the_one_the_session_names(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_no_private_folder_on_a_cluster():
    unset = SimpleNamespace(get=lambda key, default=None: default)
    context = SimpleNamespace(getConf=lambda: unset, getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=unset, sparkContext=context))


def test_written_table_cuts_the_plan(spark):
    df = written(spark.range(10).where("id > 3"))
    assert df.count() == 6 and "Range" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_staged_rows(spark):
    keys = ["007", "7", "", "a/b=c", "__HIVE_DEFAULT_PARTITION__", "null", None, " "]
    df = spark.createDataFrame([(k, float(i)) for i, k in enumerate(keys)], "k string, v double")
    with staged_by_key(df, "k") as staged:
        assert sorted(tuple(r)[:2] for r in staged.collect()) == sorted((k, float(i)) for i, k in enumerate(keys) if k is not None)
        for i, k in enumerate(keys):
            if k is not None:
                one = rows_with_key(staged, "k", k)
                assert one.columns == ["k", "v"] and [tuple(r) for r in one.collect()] == [(k, float(i))]
        assert "PartitionFilters: [isnotnull(_folder" in one._jdf.queryExecution().executedPlan().toString()
        folder = staged.inputFiles()[0].split("/_folder=")[0]
    with pytest.raises(Exception):
        spark.read.parquet(folder).count()


@pytest.mark.parametrize("kind", ["int", "double", "date", "boolean", "decimal(5,2)"])
def test_staged_rows_of_other_types(spark, kind):
    df = spark.sql(f"select cast(x as {kind}) as k from values (1), (2) as t(x)" if kind != "date" else "select date '2020-01-01' as k")
    with staged_by_key(df, "k") as staged:
        for r in df.collect():
            assert rows_with_key(staged, "k", r["k"]).count() == df.where(F.col("k") == F.lit(r["k"])).count()


def test_scratch_owns_what_is_written(spark, small_dir):
    events = spark.read.parquet(f"{small_dir}/events.parquet")
    args = ("user_id", "ts", "value", 7, "event_id")
    before = set(Path(shared_dir(spark)).iterdir())
    with scratch(spark):
        answer = moving_average(events, *args, split_rows=10).count()
        assert set(Path(shared_dir(spark)).iterdir()) > before
    assert set(Path(shared_dir(spark)).iterdir()) == before
    assert answer == moving_average(events, *args, split_rows=None).count()


def test_models_of_two_runs_and_odd_keys(spark, tmp_path):
    rows = [(k, float(i % 7), float(i % 5), i) for k in ("", "a/b", "p") for i in range(60)]
    df = spark.createDataFrame(rows, "k string, x double, y double, id long")
    folder = f"{tmp_path}/models"
    for keys in (["", "a/b"], ["p"]):
        trained = trees.random_forest(df, "k", ["x"], "y", "id", keys=keys, num_trees=1, max_depth=1)
        assert sorted(trained.models) == keys
        save_models(trained.models, trained.metrics, folder)
    models, missing = load_models(spark, ["", "a/b", "p", "q"], folder, "random_forest")
    assert sorted(models) == ["", "a/b", "p"] and missing == ["q"]
    assert sorted(r["k"] for r in load_targets(spark, folder).collect()) == ["", "a/b", "p"]


def test_saved_models_predict_the_same(spark, small_dir, tmp_path):
    lines = spark.read.parquet(f"{small_dir}/lineitem.parquet")
    args = ("l_linestatus", ["l_quantity", "l_tax"], "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey"])
    for kind, train in (("random_forest", trees.random_forest), ("gradient_boost", trees.gradient_boost)):
        size = {"num_trees": 3} if kind == "random_forest" else {"max_iter": 2}
        trained = train(lines, *args, max_depth=2, **size)
        folder = f"{tmp_path}/{kind}"
        save_models(trained.models, trained.metrics, folder)
        save_models(trained.models, trained.metrics, folder)
        models, missing = load_models(spark, ["F", "O", "X"], folder, kind)
        assert sorted(models) == ["F", "O"] and missing == ["X"]
        assert sorted(map(tuple, load_targets(spark, folder).collect())) == sorted(map(tuple, trained.metrics.collect()))
        with trees.training_table(lines, *args) as table:
            rows = trees.rows_of(table, "l_linestatus", "F")
            both = [
                sorted(r[0] for r in m.transform(rows).select("prediction").collect())
                for m in (models["F"], trained.models["F"])
            ]
        assert both[0] == both[1]
        with pytest.raises(Exception):
            save_models(trained.models, trained.metrics, folder, overwrite=False)
