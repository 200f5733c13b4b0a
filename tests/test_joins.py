import pytest

from keyspan.operators.joins import Query, compound, compound_join, dedupe_last, with_parent


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def left(spark):
    return spark.createDataFrame(
        [("a", 1.0, "l1"), ("b", None, "l2"), ("c", 3.0, "l3"), (None, 9.0, "l4")], "k string, v double, l string"
    )


@pytest.fixture
def right(spark):
    return spark.createDataFrame(
        [("a", 10.0, "r1"), ("b", 20.0, "r2"), ("d", 40.0, "r3"), (None, 90.0, "r4")], "k string, v double, r string"
    )


A, B = ("a", 1.0, "l1", "r1"), ("b", None, "l2", "r2")


@pytest.mark.parametrize(
    "how, expected",
    [
        ("inner", [A, B]),
        ("left", [A, B, ("c", 3.0, "l3", None), (None, 9.0, "l4", None)]),
        ("right", [A, B, ("d", 40.0, None, "r3"), (None, 90.0, None, "r4")]),
        (
            "outer",
            [A, B, ("c", 3.0, "l3", None), ("d", 40.0, None, "r3"), (None, 9.0, "l4", None), (None, 90.0, None, "r4")],
        ),
    ],
)
def test_left_wins_and_null_keys_match_nothing(left, right, how, expected):
    assert rows(compound((left, how, right), "k")) == sorted(expected, key=repr)
    assert rows(compound_join(left, right, "k", how)) == sorted(expected, key=repr)


def test_unknown_join(left, right):
    with pytest.raises(ValueError):
        compound((left, "cross", right), "k")


def test_last_row_wins(spark):
    df = spark.createDataFrame(
        [("a", 1, "old"), ("a", 3, "new"), ("a", None, "undated"), ("b", None, "only"), (None, 1, "x"), (None, 2, "y")],
        "k string, at int, v string",
    )
    assert rows(dedupe_last(df, "k", ["at"], keep_null_keys=False)) == [("a", 3, "new"), ("b", None, "only")]
    assert [r[2] for r in rows(dedupe_last(df, "k", ["at"])) if r[0] is None] == ["x", "y"]


def test_tree_of_queries(spark, left, right):
    seen = [("a", 1, "first"), ("a", 2, "last"), ("c", 1, "c"), (None, 1, "n")]
    visits = spark.createDataFrame(seen, "k string, at int, w string")
    tree = ((Query(visits, ["at"]),), "inner", (left, "left", right))
    assert rows(compound(tree, "k")) == [
        ("a", 2, "last", 1.0, "l1", "r1"),
        ("c", 1, "c", 3.0, "l3", None),
    ]
    assert rows(compound((left, right), "k")) == [A, B]


def test_single_query_passes_through(spark):
    visits = spark.createDataFrame([("a", 1), ("a", 2), (None, 1)], "k string, at int")
    assert rows(compound((Query(visits, ["at"]),), "k")) == [("a", 2), (None, 1)]


def test_one_row_per_key_joins_without_another_shuffle(spark, small_dir):
    events = spark.read.parquet(f"{small_dir}/events.parquet").selectExpr("user_id k", "ts", "event_id", "value")
    last = dedupe_last(events, "k", ["ts", "event_id"], keep_null_keys=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = compound_join(last, last.withColumnRenamed("value", "again"), "k")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= 2


def test_parents(spark):
    clusters = spark.createDataFrame(
        [(1, "p", True), (1, "a", False), (1, "b", False), (2, "c", False)], "cluster_id int, k string, is_center boolean"
    )
    data = spark.createDataFrame([("p", 1), ("a", 2), ("c", 3), ("zz", 4)], "k string, v int")
    assert rows(with_parent(data, clusters, "k")) == [("a", 2, "p"), ("c", 3, "none"), ("p", 1, "none"), ("zz", 4, "none")]
