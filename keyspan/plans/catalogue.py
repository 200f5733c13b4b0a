"""Every operator as a query over the test tables. A query takes ``(spark, directory)`` and returns a DataFrame.

Doubles that both engines have to agree on are rounded, arrays are reported by size and ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.functions.metrics import regression_metrics
from keyspan.functions.sampling import in_fraction, sample_fraction
from keyspan.functions.scaling import minmax_scale
from keyspan.models import clustering, transfer, trees
from keyspan.models.components import components_for, explained_variance
from keyspan.models.linear import linear_regression
from keyspan.operators import frames, summaries, windows
from keyspan.operators.joins import Query, compound, dedupe_last, with_parent
from keyspan.sources.storage import new_path, written
from keyspan.sources.tables import load_clusters, load_table, to_json_rows

DAYS = 7
LINE_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
CUSTOMER_FEATURES = ["c_acctbal", "n_orders", "spend"]


def _rounded(name: str, digits: int):
    return F.round(name, digits).alias(name)


# Series


def _event_series(spark, directory):
    return load_table(spark, directory, "events"), "user_id", "ts", "value"


def _averages(df: DataFrame) -> DataFrame:
    return df.select("user_id", "ts", "event_id", _rounded("avg", 6))


def moving_average(spark: SparkSession, directory: str) -> DataFrame:
    return _averages(windows.moving_average(*_event_series(spark, directory), DAYS, "event_id"))


def moving_average_split(spark: SparkSession, directory: str) -> DataFrame:
    """With the series cut into blocks, as for keys too large for one task."""
    rows = windows.moving_average(*_event_series(spark, directory), DAYS, "event_id", split_rows=40)
    return _averages(rows)


def moving_average_array(spark: SparkSession, directory: str) -> DataFrame:
    return _averages(windows.moving_average_from_arrays(*_event_series(spark, directory), DAYS, "event_id"))


def moving_average_daily(spark: SparkSession, directory: str) -> DataFrame:
    daily = frames.aggregate(
        load_table(spark, directory, "events"),
        [
            frames.add_fields(day=F.to_date("ts")),
            frames.group(["user_id", "day"], total=F.sum("value")),
        ],
    )
    # One row per user and day: no series is longer than the calendar.
    rows = windows.moving_average(daily, "user_id", "day", "total", DAYS, "day", split_rows=None)
    return rows.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), _rounded("avg", 6))


def _ends(points: str, field: str):
    last = F.element_at(points, -1)
    return F.when(F.size(points) > 0, last[field])


def moving_average_arrays(spark: SparkSession, directory: str) -> DataFrame:
    answers = windows.moving_average_arrays(*_event_series(spark, directory), DAYS, "event_id")
    return answers.select(
        "user_id",
        "part",
        F.size("moving_averages").alias("n_values"),
        F.round(_ends("moving_averages", "avg"), 6).alias("last_avg"),
        _ends("moving_averages", "date").alias("last_date"),
        "num_days",
        "start_date",
    )


def moving_average_request(spark: SparkSession, directory: str) -> DataFrame:
    """Asked for every customer and every supplier number: some keys twice, most of them unknown."""
    customers = load_table(spark, directory, "customer").select(
        (F.col("c_custkey") * 2).alias("pos"), F.col("c_custkey").alias("user_id")
    )
    suppliers = load_table(spark, directory, "supplier").select(
        (F.col("s_suppkey") * 2 + 1).alias("pos"), F.col("s_suppkey").alias("user_id")
    )
    events, key, order, feature = _event_series(spark, directory)
    answers = windows.moving_average_request(
        events, customers.unionAll(suppliers), key, order, feature, DAYS, "event_id"
    )
    return answers.select(
        "pos",
        "user_id",
        "part",
        F.size("moving_averages").alias("n_values"),
        F.round(_ends("moving_averages", "avg"), 6).alias("last_avg"),
        "start_date",
    )


def series(spark: SparkSession, directory: str) -> DataFrame:
    events, key, order, feature = _event_series(spark, directory)
    rows = windows.series(events, key, order, feature, "event_id")
    return rows.select(
        "user_id",
        "part",
        F.size("series").alias("n_values"),
        F.element_at("series", 1)["value"].alias("first_value"),
        F.element_at("series", 1)["date"].alias("first_date"),
        F.element_at("series", -1)["value"].alias("last_value"),
    )


# Projections, predicates, sampling, JSON


def filter_keys(spark: SparkSession, directory: str) -> DataFrame:
    """Line items of the suppliers with a positive balance."""
    suppliers = frames.find(load_table(spark, directory, "supplier"), ("s_acctbal", ">", 0.0))
    wanted = suppliers.select(F.col("s_suppkey").alias("l_suppkey"))
    lines = frames.filter_keys(load_table(spark, directory, "lineitem"), "l_suppkey", wanted)
    return frames.select_columns(lines, "l_suppkey", ["l_quantity"], "l_extendedprice", LINE_ID)


def find_compare(spark: SparkSession, directory: str) -> DataFrame:
    orders = frames.drop_incomplete(load_table(spark, directory, "orders"), ["o_custkey", "o_totalprice"])
    found = frames.find(
        orders,
        ("o_totalprice", ">=", 100000.0),
        ("o_totalprice", "<", 300000.0),
        ("o_orderstatus", "=", "F"),
    )
    return found.select("o_orderkey", "o_custkey", "o_totalprice")


def aggregate_steps(spark: SparkSession, directory: str) -> DataFrame:
    """The ten suppliers with the largest returned revenue."""
    return frames.aggregate(
        load_table(spark, directory, "lineitem"),
        [
            frames.match(F.col("l_returnflag") == "R"),
            frames.add_fields(revenue=F.col("l_extendedprice") * (1 - F.col("l_discount"))),
            frames.group("l_suppkey", revenue=F.round(F.sum("revenue"), 2), lines=F.count(F.lit(1))),
            frames.sort(F.desc("revenue"), "l_suppkey"),
            frames.limit(10),
        ],
    )


def json_rows(spark: SparkSession, directory: str) -> DataFrame:
    parts = load_table(spark, directory, "part").select(
        "p_partkey", "p_name", F.when(F.col("p_size") >= 10, F.col("p_size")).alias("p_size")
    )
    return to_json_rows(parts)


def sampled(spark: SparkSession, directory: str) -> DataFrame:
    lines = sample_fraction(load_table(spark, directory, "lineitem"), 0.3, LINE_ID)
    return lines.select(*LINE_ID, "l_quantity")


def train_test_split(spark: SparkSession, directory: str) -> DataFrame:
    lines = load_table(spark, directory, "lineitem")
    role = F.when(in_fraction(LINE_ID, 0.8, "split", 1), "train").otherwise("test")
    return (
        lines.withColumn("role", role)
        .groupBy("l_returnflag", "role")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))
    )


def minmax_scaled(spark: SparkSession, directory: str) -> DataFrame:
    scaled = minmax_scale(_customer_features(spark, directory), CUSTOMER_FEATURES)
    return scaled.select("c_custkey", *[_rounded(c, 9) for c in CUSTOMER_FEATURES])


# Counts and summaries


def count_tables(spark: SparkSession, directory: str) -> DataFrame:
    return summaries.count_tables(spark, directory, ["lineitem", "region", "nation", "customer", "orders", "customer"])


def mean_by_key(spark: SparkSession, directory: str) -> DataFrame:
    events = load_table(spark, directory, "events")
    means = summaries.mean_by_key(events, "user_id", "value", "ts", "2024-01-05", "2024-01-25")
    return means.select("user_id", _rounded("mean", 6))


def mean_over_dates(spark: SparkSession, directory: str) -> DataFrame:
    """The mean of the user with the most events."""
    events = load_table(spark, directory, "events")
    busiest = events.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first()["user_id"]
    means = summaries.mean_over_dates(events, "user_id", busiest, "value", "ts", "2024-01-05", "2024-01-25")
    return means.select(F.lit(busiest).cast("bigint").alias("user_id"), _rounded("mean", 6))


def _supplier_clusters(spark: SparkSession, directory: str, key: str = "s_suppkey") -> DataFrame:
    """Suppliers by nation; the lowest number of a nation is its centre."""
    members = load_table(spark, directory, "supplier").select(
        F.col("s_nationkey").alias("cluster_id"), F.col("s_suppkey").alias(key)
    )
    lowest = members.groupBy("cluster_id").agg(F.min(key).alias("_lowest"))
    return members.join(lowest, "cluster_id").select(
        "cluster_id", key, (F.col(key) == F.col("_lowest")).alias("is_center")
    )


def key_summary(spark: SparkSession, directory: str) -> DataFrame:
    lines = load_table(spark, directory, "lineitem")
    features = ["l_quantity", "l_extendedprice"]
    stats = summaries.key_summary(lines, "l_suppkey", features)
    stats = with_parent(stats, _supplier_clusters(spark, directory, "l_suppkey"), "l_suppkey")
    figures = [f"{stat}_{f}" for f in features for stat in ("stddev", "avg")]
    return stats.select("l_suppkey", "parent", *[_rounded(c, 4) for c in figures])


def cluster_groups(spark: SparkSession, directory: str) -> DataFrame:
    groups = summaries.cluster_groups(_supplier_clusters(spark, directory), "s_suppkey")
    return groups.withColumn("children", F.array_join("children", ","))


def cluster_file(spark: SparkSession, directory: str) -> DataFrame:
    """The same groups by way of a cluster file."""
    path = new_path(spark, "clusters")
    _supplier_clusters(spark, directory, "gis_join").write.csv(path, header=True)
    clusters = load_clusters(spark, path, key="s_suppkey").withColumn("s_suppkey", F.col("s_suppkey").cast("bigint"))
    groups = summaries.cluster_groups(clusters, "s_suppkey")
    return groups.withColumn("children", F.array_join("children", ","))


def cluster_members(spark: SparkSession, directory: str) -> DataFrame:
    return summaries.cluster_members(_supplier_clusters(spark, directory), "s_suppkey")


# Joins


def _orders_side(spark, directory) -> Query:
    orders = load_table(spark, directory, "orders").select(
        F.col("o_custkey").alias("id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderstatus").alias("status"),
        "o_orderdate",
        "o_orderkey",
    )
    return Query(orders, ["o_orderdate", "o_orderkey"])


def _events_side(spark, directory) -> Query:
    events = load_table(spark, directory, "events").select(
        F.col("user_id").alias("id"), F.col("value").alias("amount"), "event_type", "ts", "event_id"
    )
    return Query(events, ["ts", "event_id"])


def _customers(spark, directory) -> DataFrame:
    return load_table(spark, directory, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("segment")
    )


def _labels(spark, directory) -> DataFrame:
    return load_table(spark, directory, "labels").select(
        F.col("doc_id").alias("id"),
        F.col("quality").cast("double").alias("amount"),
        F.col("toxic").cast("double").alias("toxic"),
    )


def _joined(tree) -> DataFrame:
    rows = compound(tree, "id")
    # Numbers that may be missing are reported as text.
    return rows.withColumn("event_id", F.col("event_id").cast("string")) if "event_id" in rows.columns else rows


def last_orders(spark: SparkSession, directory: str) -> DataFrame:
    side = _orders_side(spark, directory)
    return dedupe_last(side.rows, "id", side.order_by)


def compound_inner(spark: SparkSession, directory: str) -> DataFrame:
    return _joined((_orders_side(spark, directory), "inner", _customers(spark, directory)))


def compound_left(spark: SparkSession, directory: str) -> DataFrame:
    return _joined((_customers(spark, directory), "left", _events_side(spark, directory)))


def compound_right(spark: SparkSession, directory: str) -> DataFrame:
    return _joined((_events_side(spark, directory), "right", _customers(spark, directory)))


def compound_full(spark: SparkSession, directory: str) -> DataFrame:
    """Labels of documents and last events of users share numbers only: rows of one side, of the other, of both."""
    return _joined((_events_side(spark, directory), "outer", _labels(spark, directory)))


def compound_nested(spark: SparkSession, directory: str) -> DataFrame:
    purchases = (_orders_side(spark, directory), "inner", _customers(spark, directory))
    return _joined((purchases, "left", ((_events_side(spark, directory),), "inner", _labels(spark, directory))))


# Linear regression


def _line_fits(spark, directory, feature="l_quantity", **params) -> DataFrame:
    lines = load_table(spark, directory, "lineitem")
    return linear_regression(lines, "l_suppkey", feature, "l_extendedprice", history=False, **params)


def _fit_report(fits: DataFrame, slope_digits: int = 4, key: str = "l_suppkey") -> DataFrame:
    return fits.select(
        key,
        _rounded("rmse", 3),
        _rounded("r2", 8),
        _rounded("intercept", 2),
        F.round(F.element_at("slope_coefficients", 1), slope_digits).alias("slope"),
    )


def linear_regression_plain(spark: SparkSession, directory: str) -> DataFrame:
    return _fit_report(_line_fits(spark, directory, reg_param=0.0))


def linear_regression_ridge(spark: SparkSession, directory: str) -> DataFrame:
    return _fit_report(_line_fits(spark, directory, reg_param=0.5, standardization=False))


def linear_regression_elastic(spark: SparkSession, directory: str) -> DataFrame:
    return _fit_report(_line_fits(spark, directory, reg_param=10.0, elastic_net=0.8, standardization=False))


def linear_regression_origin(spark: SparkSession, directory: str) -> DataFrame:
    return _fit_report(_line_fits(spark, directory, reg_param=0.5, fit_intercept=False))


def linear_regression_time(spark: SparkSession, directory: str) -> DataFrame:
    """Price against the ship date in seconds."""
    return _fit_report(_line_fits(spark, directory, "l_shipdate", reg_param=0.0), 10)


def prediction_metrics(spark: SparkSession, directory: str) -> DataFrame:
    fits = _line_fits(spark, directory, reg_param=0.0).select(
        "l_suppkey", "intercept", F.element_at("slope_coefficients", 1).alias("slope")
    )
    predicted = load_table(spark, directory, "lineitem").join(fits, "l_suppkey").select(
        "l_returnflag",
        F.col("l_extendedprice").alias("label"),
        (F.col("intercept") + F.col("slope") * F.col("l_quantity")).alias("prediction"),
    )
    figures = regression_metrics(predicted, by=["l_returnflag"])
    return figures.select(
        "l_returnflag", "n", _rounded("rmse", 3), _rounded("r2", 8), _rounded("r2_swapped", 4)
    )


# Iterative fits of the same regression, one per return flag


def linear_regression_huber(spark: SparkSession, directory: str) -> DataFrame:
    lines = load_table(spark, directory, "lineitem")
    return linear_regression(lines, "l_returnflag", "l_quantity", "l_extendedprice", loss="huber", max_iterations=20)


def linear_regression_history(spark: SparkSession, directory: str) -> DataFrame:
    lines = load_table(spark, directory, "lineitem")
    fits = linear_regression(
        lines, "l_returnflag", "l_quantity", "l_extendedprice", reg_param=0.3, elastic_net=0.5, history=True
    )
    return _fit_report(fits, 3, "l_returnflag").withColumn("rmse", F.round("rmse", 2))


# Clustering


def _customer_features(spark, directory) -> DataFrame:
    orders = load_table(spark, directory, "orders")
    spending = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("spend")
    )
    customers = load_table(spark, directory, "customer").select("c_custkey", "c_acctbal")
    return customers.join(spending, "c_custkey", "left")


def _cluster_args(spark, directory) -> tuple:
    return _customer_features(spark, directory), "c_custkey", CUSTOMER_FEATURES


def kmeans(spark: SparkSession, directory: str) -> DataFrame:
    return clustering.kmeans(*_cluster_args(spark, directory), k=10, unique_key=True)


def bisecting_kmeans(spark: SparkSession, directory: str) -> DataFrame:
    return clustering.bisecting_kmeans(*_cluster_args(spark, directory), k=10, unique_key=True)


def gaussian_mixture(spark: SparkSession, directory: str) -> DataFrame:
    return clustering.gaussian_mixture(*_cluster_args(spark, directory), k=4, max_iter=30, unique_key=True)


def lda(spark: SparkSession, directory: str) -> DataFrame:
    answers = clustering.lda(*_cluster_args(spark, directory), k=4, max_iter=10, unique_key=True)
    return answers.select("c_custkey", "prediction")


def kmeans_centers(spark: SparkSession, directory: str) -> DataFrame:
    model, rows = clustering.fit_kmeans(*_cluster_args(spark, directory), k=10, unique_key=True)
    return clustering.cluster_centers(model, rows)


def mixture_components(spark: SparkSession, directory: str) -> DataFrame:
    model, rows = clustering.fit_gaussian_mixture(
        *_cluster_args(spark, directory), k=4, max_iter=30, unique_key=True
    )
    return clustering.gaussians(model, rows)


def lda_bounds(spark: SparkSession, directory: str) -> DataFrame:
    model, rows = clustering.fit_lda(*_cluster_args(spark, directory), k=4, max_iter=10, unique_key=True)
    return clustering.lda_quality(model, rows)


def principal_components(spark: SparkSession, directory: str) -> DataFrame:
    scaled = minmax_scale(_customer_features(spark, directory), CUSTOMER_FEATURES)
    shares = explained_variance(scaled, CUSTOMER_FEATURES, 3)
    needed = components_for(shares, 0.95)
    rows = [(n, round(share, 8), needed) for n, share in enumerate(shares, start=1)]
    return spark.createDataFrame(rows, "component int, explained_variance double, n_components int")


# Trees. The key is return flag and line status, which cuts the line items into six large parts.


def _lines(spark, directory) -> DataFrame:
    return load_table(spark, directory, "lineitem").withColumn(
        "line_kind", F.concat_ws("-", "l_returnflag", "l_linestatus")
    )


def _tree_args(spark, directory) -> tuple:
    return _lines(spark, directory), "line_kind", LINE_FEATURES, "l_extendedprice", LINE_ID


def _line_clusters(lines: DataFrame) -> DataFrame:
    """One cluster per return flag, its lowest line status is the centre.

    The kinds are written down: several steps of a training read them, the line items only once.
    """
    kinds = written(lines.select("l_returnflag", "l_linestatus", "line_kind").distinct())
    lowest = kinds.groupBy("l_returnflag").agg(F.min("l_linestatus").alias("_lowest"))
    return kinds.join(lowest, "l_returnflag").select(
        F.ascii("l_returnflag").alias("cluster_id"),
        "line_kind",
        (F.col("l_linestatus") == F.col("_lowest")).alias("is_center"),
    )


def _accuracy(metrics: DataFrame) -> DataFrame:
    return metrics.select("line_kind", _rounded("rmse", 4), _rounded("r2", 8))


def random_forest(spark: SparkSession, directory: str) -> DataFrame:
    return trees.random_forest(
        *_tree_args(spark, directory), num_trees=10, max_depth=4, max_bins=50, train_split=0.9
    ).metrics


def gradient_boost(spark: SparkSession, directory: str) -> DataFrame:
    return trees.gradient_boost(
        *_tree_args(spark, directory), max_iter=5, max_depth=4, max_bins=50, train_split=0.9
    ).metrics


STUMP = {"max_depth": 1, "max_bins": 64}
RF_STUMP = {**STUMP, "is_bootstrap": False}
RF_STUMP_GRID = {"minWeightFractionPerNode": [0.1, 0.45]}
GBT_STUMP_GRID = {"maxIter": [1, 2]}


def random_forest_stump(spark: SparkSession, directory: str) -> DataFrame:
    """A single split per key, which SQL can find as well."""
    return _accuracy(trees.random_forest(*_tree_args(spark, directory), **RF_STUMP).metrics)


def gradient_boost_stumps(spark: SparkSession, directory: str) -> DataFrame:
    return _accuracy(trees.gradient_boost(*_tree_args(spark, directory), **STUMP, max_iter=2).metrics)


# What parents are searched by where SQL can find them as well; without it the default grid and folds hold.
STUMP_SEARCH = {
    "random_forest": {"grid": RF_STUMP_GRID, "folds": 2, **RF_STUMP},
    "gradient_boost": {"grid": GBT_STUMP_GRID, "folds": 2, **STUMP},
}


def _parents(spark, directory, kind: str, **search):
    lines, *rest = _tree_args(spark, directory)
    clusters = _line_clusters(lines)
    parents = transfer.train_parents(lines, clusters, kind, *rest, **search)
    return lines, clusters, rest, parents


def random_forest_parents(spark: SparkSession, directory: str) -> DataFrame:
    return _accuracy(_parents(spark, directory, "random_forest", **STUMP_SEARCH["random_forest"])[3].metrics)


def gradient_boost_parents(spark: SparkSession, directory: str) -> DataFrame:
    return _accuracy(_parents(spark, directory, "gradient_boost", **STUMP_SEARCH["gradient_boost"])[3].metrics)


def _scores(spark, directory, kind: str, setting: str) -> DataFrame:
    scores = _parents(spark, directory, kind, **STUMP_SEARCH[kind])[3].scores
    return scores.select("line_kind", F.col("setting")[setting].alias("setting"), _rounded("avg_rmse", 4))


def random_forest_exhaustive(spark: SparkSession, directory: str) -> DataFrame:
    return _scores(spark, directory, "random_forest", "minWeightFractionPerNode")


def gradient_boost_exhaustive(spark: SparkSession, directory: str) -> DataFrame:
    return _scores(spark, directory, "gradient_boost", "maxIter")


def _rounds(history: DataFrame) -> DataFrame:
    return history.select(
        "line_kind", "phase", "round", "fraction", _rounded("rmse", 4), _rounded("r2", 8), "reached"
    )


def _children(spark, directory, kind: str, **search) -> DataFrame:
    lines, clusters, rest, parents = _parents(spark, directory, kind, **search)
    children = transfer.train_children(lines, clusters, parents.models, parents.metrics, kind, *rest)
    return _rounds(children.history)


def random_forest_saved(spark: SparkSession, directory: str) -> DataFrame:
    """Children of parents that were saved and loaded again."""
    lines, *rest = _tree_args(spark, directory)
    workflow = (lines, _line_clusters(lines), "random_forest")
    folder = new_path(spark, "models")
    transfer.ensemble(*workflow, "exhaustive", folder, *rest, grid=RF_STUMP_GRID, folds=2, **RF_STUMP)
    return _rounds(transfer.ensemble(*workflow, "transfer", folder, *rest).history)


def random_forest_transfer(spark: SparkSession, directory: str) -> DataFrame:
    return _children(spark, directory, "random_forest", **STUMP_SEARCH["random_forest"])


def gradient_boost_transfer(spark: SparkSession, directory: str) -> DataFrame:
    """Children of parents whose settings are the best of the default grid, over its folds."""
    return _children(spark, directory, "gradient_boost")


def gradient_boost_from_first(spark: SparkSession, directory: str) -> DataFrame:
    lines, *rest = _tree_args(spark, directory)
    kinds = sorted(r[0] for r in lines.select("line_kind").distinct().collect())
    return _rounds(transfer.train_from_first(lines, kinds, *rest, **STUMP, max_iter=2).history)


def gradient_boost_until(spark: SparkSession, directory: str) -> DataFrame:
    """All line items as one key, on growing samples up to a fixed rmse."""
    lines = load_table(spark, directory, "lineitem").withColumn("line_kind", F.lit("all"))
    result = transfer.train_until(
        lines, "all", "line_kind", LINE_FEATURES, "l_extendedprice", LINE_ID,
        target_rmse=28850.0, **STUMP, max_iter=2,
    )
    return _rounds(result.history)


QUERIES = {
    f.__name__: f
    for f in (
        moving_average,
        moving_average_split,
        moving_average_array,
        moving_average_daily,
        moving_average_arrays,
        moving_average_request,
        series,
        filter_keys,
        find_compare,
        aggregate_steps,
        json_rows,
        sampled,
        train_test_split,
        minmax_scaled,
        count_tables,
        mean_by_key,
        mean_over_dates,
        key_summary,
        cluster_groups,
        cluster_file,
        cluster_members,
        last_orders,
        compound_inner,
        compound_left,
        compound_right,
        compound_full,
        compound_nested,
        linear_regression_plain,
        linear_regression_ridge,
        linear_regression_elastic,
        linear_regression_origin,
        linear_regression_time,
        linear_regression_huber,
        linear_regression_history,
        prediction_metrics,
        kmeans,
        bisecting_kmeans,
        gaussian_mixture,
        lda,
        kmeans_centers,
        mixture_components,
        lda_bounds,
        principal_components,
        random_forest,
        gradient_boost,
        random_forest_stump,
        gradient_boost_stumps,
        random_forest_parents,
        gradient_boost_parents,
        random_forest_exhaustive,
        gradient_boost_exhaustive,
        random_forest_transfer,
        random_forest_saved,
        gradient_boost_transfer,
        gradient_boost_from_first,
        gradient_boost_until,
    )
}
