import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from keyspan.models.linear import linear_regression, lr_params


def data(spark):
    rows = [("a", float(x), 3.0 * x + 5 + (x * 37 % 7)) for x in range(40)]
    rows += [("b", float(x % 13), -1.5 * (x % 13) + (x * 11 % 5)) for x in range(50)]
    rows += [("null", 1.0, None), ("null", None, 1.0)]
    return spark.createDataFrame(rows, "k string, x double, y double")


@pytest.mark.parametrize("standardization", [True, False])
@pytest.mark.parametrize("fit_intercept", [True, False])
@pytest.mark.parametrize("reg_param, elastic_net", [(0.0, 0.0), (0.5, 0.0), (0.3, 0.5), (0.3, 1.0), (9.0, 1.0)])
def test_formula_agrees_with_the_library(spark, standardization, fit_intercept, reg_param, elastic_net):
    settings = dict(reg_param=reg_param, elastic_net=elastic_net, standardization=standardization, fit_intercept=fit_intercept)
    got = {r["k"]: r for r in linear_regression(data(spark), "k", "x", "y", **settings).collect()}
    assert set(got) == {"a", "b"}
    for k, row in got.items():
        own = VectorAssembler(inputCols=["x"], outputCol="features").transform(data(spark).where(f"k = '{k}'"))
        model = LinearRegression(
            labelCol="y", maxIter=99, tol=1e-12, regParam=reg_param, elasticNetParam=elastic_net,
            standardization=standardization, fitIntercept=fit_intercept,
        ).fit(own)
        assert row["slope_coefficients"] == pytest.approx(list(model.coefficients), rel=1e-6, abs=1e-9)
        assert row["intercept"] == pytest.approx(model.intercept, rel=1e-6, abs=1e-9)
        assert row["rmse"] == pytest.approx(model.summary.rootMeanSquaredError, rel=1e-6)
        assert row["r2"] == pytest.approx(model.summary.r2, rel=1e-6, abs=1e-9)
        if reg_param * elastic_net == 0:
            assert row["total_iterations"] == model.summary.totalIterations == 0
            assert row["objective_history"] == list(model.summary.objectiveHistory)


def test_degenerate_keys(spark):
    rows = [("x", 2.0, float(y)) for y in range(4)] + [("y", float(x), 7.0) for x in range(4)] + [("one", 1.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    fits = linear_regression(df, "k", "x", "y").collect()
    got = {r["k"]: (r["slope_coefficients"], r["intercept"], r["rmse"], r["r2"]) for r in fits}
    assert got["x"] == ([0.0], 1.5, pytest.approx(1.25**0.5), 0.0)
    assert got["y"] == ([0.0], 7.0, 0.0, None)
    assert got["one"] == ([0.0], 3.0, 0.0, None)


def test_constant_x_through_the_origin(spark):
    df = spark.createDataFrame([("x", 2.0, float(y)) for y in range(1, 5)], "k string, x double, y double")
    row = linear_regression(df, "k", "x", "y", fit_intercept=False).first()
    assert row["slope_coefficients"] == [0.0] and row["r2"] == 0.0 and row["intercept"] == 0.0


def test_requested_keys_and_history(spark):
    got = linear_regression(data(spark), "k", ["x"], "y", keys=["b", "zzz"]).collect()
    assert [r["k"] for r in got] == ["b"]
    got = linear_regression(
        data(spark), "k", ["x"], "y", keys=["b", "zzz"], reg_param=0.3, elastic_net=0.5, history=True
    ).collect()
    assert [r["k"] for r in got] == ["b"] and got[0]["total_iterations"] == len(got[0]["objective_history"]) - 1 > 0
    without = linear_regression(
            data(spark), "k", "x", "y", keys=["b"], reg_param=0.3, elastic_net=0.5, history=False
        ).first()
    assert without["objective_history"] is None
    assert without["slope_coefficients"] == pytest.approx(got[0]["slope_coefficients"], rel=1e-3)


@pytest.mark.parametrize("settings", [dict(loss="huber", max_iterations=50), dict(solver="l-bfgs", max_iterations=50)])
def test_iterative_fits(spark, settings):
    got = {r["k"]: r for r in linear_regression(data(spark), "k", "x", "y", reg_param=0.0, **settings).collect()}
    assert set(got) == {"a", "b"} and got["a"]["slope_coefficients"][0] == pytest.approx(3.0, abs=0.1)


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_time_as_feature(spark, kind):
    df = spark.range(20).selectExpr(
        "'k' AS k", f"CAST(date_add(DATE'2020-01-01', CAST(id AS INT)) AS {kind}) AS at", "2.0D * id + 1 AS y"
    )
    row = linear_regression(df, "k", "at", "y", reg_param=0.0).first()
    assert row["slope_coefficients"][0] * 86400 == pytest.approx(2.0)
    assert row["intercept"] + row["slope_coefficients"][0] * 1577836800 == pytest.approx(1.0, abs=1e-6)


def test_one_feature_only(spark):
    with pytest.raises(ValueError):
        linear_regression(data(spark), "k", ["x", "y"], "y")
    with pytest.raises(ValueError):
        linear_regression(data(spark), "k", [], "y")


@pytest.mark.parametrize(
    "name, target, inside, outside, default",
    [
        ("aggregation_depth", "aggregationDepth", [2, 10], [1, 11], 2),
        ("max_iterations", "maxIter", [0, 99], [-1, 100], 10),
        ("elastic_net", "elasticNetParam", [0.0, 1.0], [-0.1, 1.1], 0.0),
        ("epsilon", "epsilon", [1.01, 10.0], [1.0, 10.1], 1.35),
        ("reg_param", "regParam", [0.0, 10.0], [-0.1, 10.1], 0.5),
        ("tolerance", "tol", [0.0, 10.0], [-0.1, 10.1], 1e-6),
        ("fit_intercept", "fitIntercept", [True, False], [None], True),
        ("standardization", "standardization", [True, False], [None], True),
        ("loss", "loss", ["huber"], ["", "  ", None], "squaredError"),
        ("solver", "solver", ["normal"], ["", None], "auto"),
    ],
)
def test_parameter_rules(name, target, inside, outside, default):
    for value in inside:
        assert lr_params(**{name: value})[target] == value
    for value in outside:
        assert lr_params(**{name: value})[target] == default
    with pytest.raises(ValueError):
        lr_params(nonsense=1)


def test_points_on_a_line_leave_no_error(spark):
    df = spark.createDataFrame([("a", float(i), 100000.0 * i) for i in range(500)], "`my.key` string, x double, y double")
    for intercept in (True, False):
        fit = linear_regression(df, "my.key", "x", "y", reg_param=0.0, fit_intercept=intercept).first()
        assert fit["rmse"] < 1e-6 * 5e7 * 1e-3 and fit["r2"] > 1 - 1e-12


def with_outliers(spark):
    rows = [("a", float(x), 3.0 * x + 5 + (x * 37 % 7)) for x in range(60)] + [("a", float(7 * x), 900.0 + 50 * x) for x in range(6)]
    rows += [("b", float(x % 13) / 100, -1.5 * (x % 13) + (x * 11 % 5)) for x in range(90)] + [("b", 0.01, -500.0)]
    rows += [("", 20.0 + x, 100.0 + 0.01 * x + (x * 29 % 11)) for x in range(70)] + [("", 23.0, 2e3)]
    return spark.createDataFrame(rows, "k string, x double, y double")


@pytest.mark.parametrize("settings", [dict(reg_param=0.4, standardization=False, epsilon=1.1), dict(reg_param=0.0, fit_intercept=False)])
def test_huber_is_that_of_the_library(spark, settings):
    df = with_outliers(spark)
    got = {r["k"]: r for r in linear_regression(df, "k", "x", "y", loss="huber", max_iterations=40, tolerance=1e-9, **settings).collect()}
    names = {"reg_param": "regParam", "epsilon": "epsilon", "standardization": "standardization", "fit_intercept": "fitIntercept"}
    own = {names[n]: v for n, v in settings.items()}
    for k, row in got.items():
        table = VectorAssembler(inputCols=["x"], outputCol="features").transform(df.where(f"k = '{k}'"))
        model = LinearRegression(labelCol="y", loss="huber", maxIter=5000, tol=1e-15, **own).fit(table)
        assert row["slope_coefficients"] == pytest.approx(list(model.coefficients), rel=1e-6, abs=1e-6)
        # The library stops within its own tolerance of the minimum; this one is no higher.
        assert row["objective_history"][-1] <= model.summary.objectiveHistory[-1] * (1 + 1e-9)
        assert row["intercept"] == pytest.approx(model.intercept, rel=1e-5, abs=1e-5)
        assert row["rmse"] == pytest.approx(model.summary.rootMeanSquaredError, rel=1e-5)
        assert row["r2"] == pytest.approx(model.summary.r2, rel=1e-5, abs=1e-5)
        assert row["total_iterations"] == len(row["objective_history"]) < 40
        assert row["objective_history"][-1] <= row["objective_history"][0] * (1 + 1e-12)
        assert row["objective_history"][-1] == pytest.approx(model.summary.objectiveHistory[-1], rel=1e-6)


def test_huber_of_odd_keys(spark):
    rows = [("line", float(x), 2.0 * x) for x in range(9)] + [("one", 1.0, 3.0)] + [("x", 2.0, float(y * y)) for y in range(9)]
    df = spark.createDataFrame(rows, "`my.key` string, x double, y double")
    got = {r["my.key"]: r for r in linear_regression(df, "my.key", "x", "y", loss="huber", reg_param=0.0, max_iterations=5).collect()}
    assert got["line"]["slope_coefficients"][0] == pytest.approx(2.0) and got["line"]["total_iterations"] == 0
    assert got["one"]["intercept"] == 3.0 and got["x"]["slope_coefficients"] == [0.0]
    assert linear_regression(df.limit(0), "my.key", "x", "y", loss="huber").collect() == []
    with pytest.raises(ValueError):
        linear_regression(df, "my.key", "x", "y", loss="huber", elastic_net=0.5)


def test_jobs_do_not_depend_on_keys(spark):
    def jobs(n, name, **settings):
        df = spark.range(60 * n).selectExpr("cast(id % {} as string) as k".format(n), "id % 7 * 1.0 as x", "id % 11 * 1.0 as y")
        spark.sparkContext.setJobGroup(f"linear-{name}-{n}", "")
        linear_regression(df, "k", "x", "y", **settings).collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"linear-{name}-{n}"))

    for name, settings in (("huber", dict(loss="huber", max_iterations=3, tolerance=0.0)), ("l1", dict(reg_param=0.3, elastic_net=0.5))):
        assert abs(jobs(30, name, **settings) - jobs(2, name, **settings)) <= 2


def test_points_near_a_line_keep_their_digits(spark):
    rows = [(k, float(i), scale * (3.0 * i + 1.0 + 1e-9 * (1 if i % 2 else -1))) for k, scale in (("a", 1.0), ("b", 1e6)) for i in range(1000)]
    rows += [("rough", float(i), 5.0 * (i % 3)) for i in range(100)]
    got = {r["k"]: r["rmse"] for r in linear_regression(spark.createDataFrame(rows, "k string, x double, y double"), "k", "x", "y", reg_param=0.0).collect()}
    # Labels up to 3,000 are known to 4e-13, so the error to three digits of 1e-9.
    assert got["a"] == pytest.approx(1e-9, rel=2e-3) and got["b"] == pytest.approx(1e-3, rel=2e-3)


def test_values_out_of_range_warn():
    with pytest.warns(UserWarning, match="max_iterations=100"):
        assert lr_params(max_iterations=100)["maxIter"] == 10
