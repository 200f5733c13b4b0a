import json

import pytest
from pyspark.sql import functions as F

from keyspan.operators.documents import expression, run_documents


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("a", 3, 3.0), ("a", 1, 1.0), ("a", 2, None), ("b", 1, 5.0), ("b", 4, 6.0), ("c", 9, None)], "k string, at int, v double")


def value(spark, document, **columns):
    df = spark.range(1).select(*[F.lit(v).alias(n) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(n) for n, v in columns.items()], F.lit(1).alias("one"))
    return df.select(expression(document).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "document, want",
    [
        ({"$arrayElemAt": ["$l", 0]}, 10),
        ({"$arrayElemAt": ["$l", -1]}, 40),
        ({"$arrayElemAt": ["$l", 4]}, None),
        ({"$range": [0, 3]}, [0, 1, 2]),
        ({"$range": [0, {"$subtract": [{"$size": "$l"}, 6]}]}, []),
        ({"$range": [5, 0, -2]}, [5, 3, 1]),
        ({"$slice": ["$l", 1, 2]}, [20, 30]),
        ({"$slice": ["$l", 3, 9]}, [40]),
        ({"$slice": ["$l", -2]}, [30, 40]),
        ({"$slice": ["$l", 2]}, [10, 20]),
        ({"$slice": ["$l", -9]}, [10, 20, 30, 40]),
        ({"$avg": "$l"}, 25.0),
        ({"$avg": {"$slice": ["$l", 9, 2]}}, None),
        ({"$add": [1, 2, "$one"]}, 4),
        ({"$divide": ["$one", 0]}, None),
        ({"$multiply": ["$one", 3]}, 3),
        ({"$map": {"input": "$l", "as": "v", "in": {"$add": ["$$v", "$one"]}}}, [11, 21, 31, 41]),
        ({"$max": "$l"}, 40),
        ({"a": "$one", "b": "text"}, (1, "text")),
    ],
)
def test_expressions(spark, document, want):
    assert value(spark, document, l=[10, 20, 30, 40]) == want


def test_stages(rows):
    pipeline = [
        {"$match": {"k": {"$in": ["a", "b"]}, "v": {"$ne": None}}},
        {"$sort": {"at": 1}},
        {"$group": {"_id": "$k", "s": {"$push": {"v": "$v", "at": "$at"}}, "n": {"$sum": 1}, "last": {"$last": "$v"}}},
        {"$addFields": {"first": {"$arrayElemAt": ["$s.at", 0]}}},
        {"$project": {"first": 1, "n": 1, "last": 1, "values": "$s.v"}},
        {"$sort": {"_id": -1}},
    ]
    got = run_documents(rows, json.dumps(pipeline)).collect()
    assert [(r["_id"], r["first"], r["n"], r["last"], r["values"]) for r in got] == [("b", 1, 2, 6.0, [5.0, 6.0]), ("a", 1, 2, 3.0, [1.0, 3.0])]
    down = run_documents(rows, [{"$sort": {"at": -1}}, {"$group": {"_id": None, "f": {"$first": "$at"}, "all": {"$push": "$at"}}}]).first()
    assert (down["_id"], down["f"], down["all"]) == (None, 9, [9, 4, 3, 2, 1, 1])
    assert [r["at"] for r in run_documents(rows, [{"$sort": {"at": -1, "k": 1}}, {"$limit": 2}]).collect()] == [9, 4]
    assert sorted(r["_id"] for r in run_documents(rows, [{"$group": {"_id": "$k"}}]).collect()) == ["a", "b", "c"]
    assert [r["k"] for r in run_documents(rows, [{"$match": {"at": {"$gte": 3, "$lt": 9}}}, {"$sort": {"at": 1}}, {"$project": {"_id": 0, "k": 1}}]).collect()] == ["a", "b"]
    assert run_documents(rows, "[]").count() == 6


def test_a_sort_before_a_group_sorts_no_rows(rows):
    plan = run_documents(rows, [{"$sort": {"at": 1}}, {"$group": {"_id": "$k", "s": {"$push": "$v"}}}])
    assert "rangepartitioning" not in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize(
    "stages",
    [
        [{"$lookup": {}}],
        [{"$match": {}, "$limit": 1}],
        [{"$addFields": {"x": {"$cond": []}}}],
        [{"$group": {"_id": "$k", "x": {"$stdDevPop": "$v"}}}],
        [{"$match": {"$or": []}}],
        [{"$match": {"v": {"$regex": "x"}}}],
        [{"$addFields": {"x": "$$nothing"}}],
        [{"$sort": {"at": 1, "v": -1}}, {"$group": {"_id": "$k", "x": {"$push": "$v"}}}],
        [{"$project": {"v": 0}}],
    ],
)
def test_what_is_not_known_is_named(rows, stages):
    with pytest.raises(ValueError):
        run_documents(rows, stages)
