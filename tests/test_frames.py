import datetime as dt

import pytest
from pyspark.sql import functions as F

from keyspan.operators import frames


@pytest.fixture
def df(spark):
    return spark.createDataFrame(
        [(1, "a", 1.0, 5.0), (2, "b", None, 6.0), (3, None, 3.0, 7.0), (4, "a", 4.0, 8.0)],
        "id int, k string, `10_metre_wind` double, y double",
    )


def ids(rows):
    return sorted(r["id"] for r in rows.collect())


def test_select_columns(df):
    assert frames.select_columns(df, "k", ["10_metre_wind"], "y", "id").columns == ["id", "k", "10_metre_wind", "label"]
    assert frames.select_columns(df, "k", ["y", "k"]).columns == ["k", "y"]


def test_filter_keys(df, spark):
    assert ids(frames.filter_key(df, "k", "a")) == [1, 4]
    assert ids(frames.filter_keys(df, "k", ["b", "x", "b"])) == [2]
    assert ids(frames.filter_keys(df, "k", spark.createDataFrame([("a",), ("a",)], "k string"))) == [1, 4]
    assert ids(frames.filter_keys(df, "k", [f"x{n}" for n in range(frames.IN_LIST_KEYS + 1)] + ["b"])) == [2]
    assert ids(frames.filter_keys(df, "k", [])) == []


def test_drop_incomplete(df):
    assert ids(frames.drop_incomplete(df, ["k", "10_metre_wind"])) == [1, 4]


@pytest.mark.parametrize("op, expected", [("=", [2]), (">", [3, 4]), ("<", [1]), (">=", [2, 3, 4]), ("<=", [1, 2])])
def test_comparisons(df, op, expected):
    assert ids(frames.find(df, ("y", op, 6.0))) == expected


def test_find(df):
    assert ids(frames.find(df, ("y", ">", 5.0), F.col("k").isNotNull())) == [2, 4]
    assert ids(frames.find(df)) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        frames.compare("y", "!=", 1)


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz", "string"])
def test_dates(spark, kind):
    moments = [dt.datetime(2020, 1, d) for d in (1, 2, 3, 4)]
    df = spark.createDataFrame([(i, m.isoformat(sep=" ")) for i, m in enumerate(moments)], "id int, at string")
    df = df.withColumn("at", F.col("at").cast(kind))
    assert ids(frames.filter_dates(df, "at", "2020-01-02", dt.date(2020, 1, 3))) == [1, 2]
    assert ids(frames.filter_dates(df, "at", dt.datetime(2020, 1, 2, 15), "2020-01-03 12:00:00.000 +0000")) == [1, 2]


def test_steps(df):
    got = frames.aggregate(
        df,
        [
            frames.match(F.col("k").isNotNull()),
            frames.add_fields(double=F.col("y") * 2),
            frames.group("k", total=F.sum("double"), n=F.count(F.lit(1))),
            frames.project("k", "total"),
            frames.sort(F.desc("total")),
            frames.limit(1),
        ],
    )
    assert [tuple(r) for r in got.collect()] == [("a", 26.0)]


def test_filters_reach_the_scan(spark, small_dir):
    orders = spark.read.parquet(f"{small_dir}/orders.parquet")
    found = frames.find(orders, ("o_totalprice", ">=", 1000.0)).select("o_orderkey")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice,1000.0)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_key_lists_of_any_length_cast_alike(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "`my.key` double")
    for more in (0, 600):
        keys = [1, 7.5, None, *range(1000, 1000 + more)]
        assert [r[0] for r in frames.filter_keys(df, "my.key", keys).collect()] == [1.0]
