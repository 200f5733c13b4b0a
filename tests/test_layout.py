import pytest
from pyspark.sql import functions as F

from keyspan.operators.joins import Query, compound, dedupe_last
from keyspan.operators.windows import moving_average
from keyspan.sources.layout import bounds_from_footers, by_key, counts_from_footers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    left = spark.range(3000).selectExpr("id % 97 as k", "id", "id * 7 % 31 as at", "rand(1) as v")
    right = spark.range(400).selectExpr("id % 130 as k", "id as other", "id % 11 as day")
    return left, right


def test_tables_by_key_need_no_exchange(spark, tables, monkeypatch):
    left, right = tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one, two = by_key(left, "k", 8, ["at", "id"]), by_key(right, "k", 8)
        answers = {
            "last": lambda a, b: dedupe_last(a, "k", ["at", "id"]).where("k IS NOT NULL"),
            "joined": lambda a, b: compound((Query(a, ["at", "id"]), "inner", Query(b, ["day", "other"])), "k"),
            "windows": lambda a, b: moving_average(a, "k", "at", "v", 5, "id", None),
        }
        for name, ask in answers.items():
            assert "Exchange" in plan(ask(left, right)) and "Exchange" not in plan(ask(one, two)), name
            assert sorted(map(tuple, ask(one, two).collect())) == sorted(map(tuple, ask(left, right).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_null_keys_and_dates(spark, small_dir):
    rows = spark.createDataFrame([(None, 1), (2, 2), (2, 3)], "k int, v int")
    assert sorted(by_key(rows, "k", 3).collect(), key=str) == sorted(rows.collect(), key=str)
    counted = counts_from_footers(spark, small_dir, ["nation", "lineitem", "nation"])
    assert "PushedAggregation: [COUNT(*)]" in plan(counted).replace("\\n", " ") or "COUNT(*)" in plan(counted)
    assert [(r["pos"], r["table"], r["count"]) for r in counted.orderBy("pos").collect()] == [
        (k, n, spark.read.parquet(f"{small_dir}/{n}.parquet").count()) for k, n in enumerate(("nation", "lineitem", "nation"))
    ]
    bounds = bounds_from_footers(spark, small_dir, "lineitem", ["l_partkey", "l_linenumber"])
    assert "PushedAggregation: [MIN" in plan(bounds)
    lines = spark.read.parquet(f"{small_dir}/lineitem.parquet")
    for row in bounds.collect():
        low, high = lines.agg(F.min(row["column"]).cast("string"), F.max(row["column"]).cast("string")).first()
        assert (row["low"], row["high"]) == (low, high)
    for wrong in (["l_comment"], ["l_quantity"], []):
        with pytest.raises((ValueError, KeyError)):
            bounds_from_footers(spark, small_dir, "lineitem", wrong)
    # The session that asked keeps its settings.
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")
