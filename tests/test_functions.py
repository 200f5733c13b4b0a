import pytest
from pyspark.ml.feature import MinMaxScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from keyspan.functions import assemble, minmax_scale, regression_metrics, sample_fraction, scaled_vectors, split
from keyspan.functions.sampling import fold_of, in_fraction


def test_samples_nest_and_repeat(spark):
    df = spark.range(20_000)
    small = {r[0] for r in sample_fraction(df, 0.3, "id").collect()}
    large = {r[0] for r in sample_fraction(df.repartition(7), 0.6, "id").collect()}
    assert small < large
    assert abs(len(small) / 20_000 - 0.3) < 0.02
    assert sample_fraction(df, 0.0, "id").count() == 0 and sample_fraction(df, 1.0, "id").count() == 20_000
    assert small != {r[0] for r in sample_fraction(df, 0.3, "id", seed=2).collect()}
    with pytest.raises(ValueError):
        in_fraction("id", 1.2, "sample", 1)


def test_split_is_a_partition_independent_of_the_sample(spark):
    df = spark.range(20_000)
    train, test = split(df, 0.8, "id")
    assert train.count() + test.count() == 20_000 and train.join(test, "id").count() == 0
    share = split(sample_fraction(df, 0.3, "id"), 0.8, "id")[0].count() / sample_fraction(df, 0.3, "id").count()
    assert abs(share - 0.8) < 0.02


def test_folds(spark):
    counts = spark.range(9_000).groupBy(fold_of("id", 3).alias("f")).count().collect()
    assert {r["f"] for r in counts} == {0, 1, 2} and all(abs(r["count"] - 3000) < 200 for r in counts)


def test_metrics(spark):
    rows = [(3.0, 2.5), (-0.5, 0.0), (2.0, 2.0), (7.0, 8.0), (None, 1.0)]
    pairs = spark.createDataFrame(rows, "label double, prediction double")
    row = regression_metrics(pairs).first()
    complete = pairs.na.drop()
    for name in ("rmse", "r2"):
        expected = RegressionEvaluator(metricName=name).evaluate(complete)
        assert row[name] == pytest.approx(expected)
    swapped = complete.select(F.col("label").alias("prediction"), F.col("prediction").alias("label"))
    assert row["r2_swapped"] == pytest.approx(RegressionEvaluator(metricName="r2").evaluate(swapped))
    assert row["r2"] != row["r2_swapped"] and row["n"] == 4


def test_metrics_of_constants(spark):
    pairs = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0)], "k string, label double, prediction double")
    row = regression_metrics(pairs, by=["k"]).first()
    assert row["r2"] is None and row["rmse"] == pytest.approx(0.5**0.5)
    assert regression_metrics(pairs.limit(0)).first()["rmse"] is None


def test_scaling(spark):
    df = spark.createDataFrame([(1, 5.0, 3), (2, 5.0, 5), (3, 5.0, 4), (4, None, None)], "id int, same double, n int")
    got = {r["id"]: (r["same"], r["n"]) for r in minmax_scale(df, ["same", "n"]).collect()}
    assert got == {1: (0.5, 0.0), 2: (0.5, 1.0), 3: (0.5, 0.5), 4: (None, None)}
    complete = df.na.drop()
    vectors, n_rows = scaled_vectors(complete, ["same", "n"])
    ours = {r["id"]: tuple(r["v"]) for r in vectors.select("id", vector_to_array("features").alias("v")).collect()}
    assert n_rows == 3 and ours == {i: v for i, v in got.items() if i != 4}
    raw = assemble(complete, ["same", "n"], "raw")
    theirs = MinMaxScaler(inputCol="raw", outputCol="out").fit(raw).transform(raw)
    assert ours == {r["id"]: tuple(r["v"]) for r in theirs.select("id", vector_to_array("out").alias("v")).collect()}
