"""Queries that report every entry of an answer, that clean dirty rows, or that check a model by what must hold of it; and their SQL."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.functions.metrics import regression_metrics
from keyspan.functions.sampling import split
from keyspan.functions.scaling import minmax_scale
from keyspan.models import clustering, forest_search, transfer, trees
from keyspan.models.forests import predicted
from keyspan.models.linear import linear_regression
from keyspan.models.power_iteration import power_iteration as power_iteration_clusters
from keyspan.operators import frames, windows
from keyspan.operators.documents import run_documents
from keyspan.operators.joins import Query, compound
from keyspan.plans import catalogue, oracles
from keyspan.sources.layout import bounds_from_footers, by_key, counts_from_footers
from keyspan.sources.storage import new_path
from keyspan.sources.tables import from_json_rows, load_stats, load_table, to_json_rows

# Entries of an array in the queries that cut series into parts.
PART_ROWS = 10
# Rows of the long windows.
LONG_DAYS = 130


# Every entry of the series


def _series_entries(spark, directory, **size) -> DataFrame:
    events, key, order, feature = catalogue._event_series(spark, directory)
    rows = windows.series(events, key, order, feature, "event_id", **size)
    entries = rows.select("user_id", "part", F.posexplode("series").alias("no", "entry"))
    return entries.select("user_id", "part", "no", F.col("entry.value").alias("value"), F.col("entry.date").alias("date"))


def series_entries(spark: SparkSession, directory: str) -> DataFrame:
    return _series_entries(spark, directory)


def series_parts(spark: SparkSession, directory: str) -> DataFrame:
    return _series_entries(spark, directory, array_rows=PART_ROWS)


def _average_entries(answers: DataFrame, *columns: str) -> DataFrame:
    entries = answers.select(*columns, "part", "num_days", "start_date", F.explode("moving_averages").alias("entry"))
    return entries.select(*columns, "part", "num_days", "start_date", F.round("entry.avg", 6).alias("avg"), F.col("entry.date").alias("date"))


def moving_average_entries(spark: SparkSession, directory: str) -> DataFrame:
    series = catalogue._event_series(spark, directory)
    return _average_entries(windows.moving_average_arrays(*series, catalogue.DAYS, "event_id"), "user_id")


def moving_average_parts(spark: SparkSession, directory: str) -> DataFrame:
    series = catalogue._event_series(spark, directory)
    return _average_entries(windows.moving_average_arrays(*series, catalogue.DAYS, "event_id", array_rows=PART_ROWS), "user_id")


def moving_average_request_entries(spark: SparkSession, directory: str) -> DataFrame:
    """Every supplier number is asked for, most of them twice."""
    asked = load_table(spark, directory, "supplier").select(F.explode(F.array("s_suppkey", "s_nationkey")).alias("user_id"))
    asked = asked.groupBy("user_id").count().select(F.explode(F.sequence(F.lit(1), "count")).alias("again"), "user_id")
    asked = asked.select((F.col("user_id") * 1000 + F.col("again")).cast("long").alias("pos"), "user_id")
    events, key, order, feature = catalogue._event_series(spark, directory)
    return _average_entries(windows.moving_average_request(events, asked, key, order, feature, catalogue.DAYS, "event_id"), "pos", "user_id")


# Rows with nulls and NaN


def moving_average_dirty(spark: SparkSession, directory: str) -> DataFrame:
    """Some users, values and days are missing, some values are NaN."""
    seventh, eleventh = F.col("event_id") % 7 == 0, F.col("event_id") % 11 == 0
    events = load_table(spark, directory, "events").withColumns(
        {
            "value": F.when(eleventh, F.lit(float("nan"))).when(~seventh, F.col("value")),
            "user_id": F.when(F.col("event_id") % 13 != 0, F.col("user_id")),
        }
    )
    return catalogue._averages(windows.moving_average(events, "user_id", "ts", "value", catalogue.DAYS, "event_id"))


def complete_rows(spark: SparkSession, directory: str) -> DataFrame:
    orders = load_table(spark, directory, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
    )
    return frames.drop_incomplete(orders, ["o_custkey", "o_totalprice"])


def minmax_dirty(spark: SparkSession, directory: str) -> DataFrame:
    """NaN stays and takes no part in the bounds."""
    customers = load_table(spark, directory, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 7 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("c_acctbal")
    )
    scaled = minmax_scale(customers, ["c_acctbal"])
    return scaled.select("c_custkey", F.isnan("c_acctbal").alias("is_nan"), F.when(~F.isnan("c_acctbal"), F.round("c_acctbal", 9)).alias("c_acctbal"))


def regression_dirty(spark: SparkSession, directory: str) -> DataFrame:
    """Missing features and labels, and a flag that is an empty text; a dotted key."""
    lines = load_table(spark, directory, "lineitem").select(
        F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).otherwise("").alias("line.flag"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_extendedprice")).alias("l_extendedprice"),
    )
    fits = linear_regression(lines, "line.flag", "l_quantity", "l_extendedprice", reg_param=0.0).toDF("flag", *["total_iterations", "rmse", "r2", "intercept", "slope_coefficients", "objective_history"])
    return catalogue._fit_report(fits, 4, "flag")


def compound_dirty(spark: SparkSession, directory: str) -> DataFrame:
    """Full join of two sides with missing keys and values."""
    customers = load_table(spark, directory, "customer").select(
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey")).alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("amount")
    )
    suppliers = load_table(spark, directory, "supplier").select(
        F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey")).alias("id"), F.col("s_acctbal").alias("amount"), F.col("s_nationkey").alias("nation")
    )
    return compound((customers, "outer", suppliers), "id").select(F.col("id").cast("double").alias("id"), "amount", F.col("nation").cast("double").alias("nation"))


# Tables and texts


def stats_by_resolution(spark: SparkSession, directory: str) -> DataFrame:
    return load_stats(spark, directory, "County", table="nation").select("n_nationkey", "n_name")


def json_and_back(spark: SparkSession, directory: str) -> DataFrame:
    part = load_table(spark, directory, "part").select("p_partkey", "p_name", F.when(F.col("p_size") >= 10, F.col("p_size")).alias("p_size"))
    return from_json_rows(to_json_rows(part), part.schema).withColumn("p_size", F.col("p_size").cast("double"))


# Iterative fits


def huber_of_all_rows(spark: SparkSession, directory: str) -> DataFrame:
    """With the widest epsilon every residual counts squared: the fit is least squares. One flag is an empty text."""
    lines = load_table(spark, directory, "lineitem").withColumn("flag", F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).otherwise(""))
    fits = linear_regression(
        lines, "flag", "l_quantity", "l_extendedprice", loss="huber", epsilon=10.0, reg_param=0.0, max_iterations=99, tolerance=1e-12
    )
    slope = F.element_at("slope_coefficients", 1)
    return fits.select("flag", F.round(slope, 1).alias("slope"), F.round("intercept", 0).alias("intercept"))


def iterations_are_reported(spark: SparkSession, directory: str) -> DataFrame:
    lines = load_table(spark, directory, "lineitem")
    fits = linear_regression(lines, "l_returnflag", "l_quantity", "l_extendedprice", reg_param=0.3, elastic_net=0.5)
    history = F.col("objective_history")
    falling = F.element_at(history, -1) <= F.element_at(history, 1)
    return fits.select("l_returnflag", (F.size(history) == F.col("total_iterations") + 1).alias("whole_history"), falling.alias("falling"))


# Clusterings: of groups apart, and what must hold of any


def _apart(spark, directory) -> DataFrame:
    customers = load_table(spark, directory, "customer")
    building = (F.col("c_mktsegment") == "BUILDING").cast("double")
    return customers.select("c_custkey", building.alias("building"), (building * 2 + F.col("c_custkey") % 3 * 0.01).alias("shifted"))


def _by_smallest(answers: DataFrame) -> DataFrame:
    names = answers.groupBy("prediction").agg(F.min("c_custkey").alias("smallest"))
    return answers.join(names, "prediction").select("c_custkey", "smallest")


def kmeans_apart(spark: SparkSession, directory: str) -> DataFrame:
    return _by_smallest(clustering.kmeans(_apart(spark, directory), "c_custkey", ["building", "shifted"], k=2, unique_key=True))


def bisecting_apart(spark: SparkSession, directory: str) -> DataFrame:
    return _by_smallest(clustering.bisecting_kmeans(_apart(spark, directory), "c_custkey", ["building", "shifted"], k=2, unique_key=True))


def mixture_apart(spark: SparkSession, directory: str) -> DataFrame:
    return _by_smallest(clustering.gaussian_mixture(_apart(spark, directory), "c_custkey", ["building", "shifted"], k=2, unique_key=True))


def _squared_distance(point, centre):
    return F.aggregate(F.zip_with(point, centre, lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda a, b: a + b)


def _nearest_centres(fit, spark, directory) -> DataFrame:
    """Rows assigned, rows nearer to another centre than to their own, and centres that are not the mean of their rows."""
    model, rows = fit(*catalogue._cluster_args(spark, directory), k=10, max_iter=100, unique_key=True)
    centres = clustering.cluster_centers(model, rows)
    assigned = model.transform(rows).select("prediction", vector_to_array("features").alias("point"))
    own = assigned.join(F.broadcast(centres), F.col("prediction") == F.col("cluster"))
    # Ten centres as one row beside every point.
    all_centres = F.array(*[F.array(*map(F.lit, map(float, c))) for c in model.clusterCenters()])
    distance = _squared_distance("point", "center")
    nearest = F.array_min(F.transform(all_centres, lambda c: _squared_distance("point", c)))
    means = own.groupBy("cluster").agg(*[(F.avg(F.col("point")[i]) - F.first(F.col("center")[i])).alias(f"off{i}") for i in range(3)])
    off = means.agg(F.sum((F.greatest(*[F.abs(f"off{i}") for i in range(3)]) > 1e-3).cast("int")).alias("centres_off"))
    counted = own.agg(F.count("*").alias("n_rows"), F.sum((distance > nearest + 1e-9).cast("long")).alias("nearer_elsewhere"))
    return counted.withColumn("one", F.lit(1)).join(off.withColumn("one", F.lit(1)), "one").select("n_rows", "nearer_elsewhere", F.col("centres_off").cast("long").alias("centres_off"))


def kmeans_holds(spark: SparkSession, directory: str) -> DataFrame:
    return _nearest_centres(clustering.fit_kmeans, spark, directory)


def mixture_holds(spark: SparkSession, directory: str) -> DataFrame:
    """Rows with a component, their probabilities and the weights sum to 1."""
    model, rows = clustering.fit_gaussian_mixture(*catalogue._cluster_args(spark, directory), k=10, max_iter=100, unique_key=True)
    shares = model.transform(rows).select("prediction", vector_to_array("probability").alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda a, b: a + b)
    likeliest = F.element_at("p", F.col("prediction") + 1) >= F.array_max("p") - 1e-12
    return shares.agg(
        F.count("*").alias("n_rows"),
        F.sum((F.abs(total - 1) > 1e-6).cast("long")).alias("not_one"),
        F.sum((~likeliest).cast("long")).alias("not_likeliest"),
    ).withColumn("weights", F.round(F.lit(float(sum(model.weights))), 6))


def lda_holds(spark: SparkSession, directory: str) -> DataFrame:
    """Whole topic shares: they sum to 1, and the prediction is the largest."""
    answers = clustering.lda(*catalogue._cluster_args(spark, directory), k=10, max_iter=100, unique_key=True)
    total = F.aggregate("topic_distribution", F.lit(0.0), lambda a, b: a + b)
    largest = F.element_at("topic_distribution", F.col("prediction") + 1) == F.array_max("topic_distribution")
    return answers.agg(
        F.count("*").alias("n_rows"),
        F.sum((F.abs(total - 1) > 1e-6).cast("long")).alias("not_one"),
        F.sum((~largest).cast("long")).alias("not_largest"),
    )


def bisecting_holds(spark: SparkSession, directory: str) -> DataFrame:
    """Rows assigned, rows nearer to the other side of a split on their way, and splits whose sides don't add up."""
    model, rows = clustering.fit_bisecting_kmeans(*catalogue._cluster_args(spark, directory), k=10, unique_key=True)
    # Two nodes for each of ten clusters at most.
    nodes = {r["node"]: r for r in clustering.split_tree(model, rows).collect()}
    sides: dict[int, list] = {}
    for node in nodes.values():
        sides.setdefault(node["parent"], []).append(node)
    ways = []
    for leaf in nodes.keys() - sides.keys():
        way, node = [], nodes[leaf]
        while node["parent"] is not None:
            other = next(n for n in sides[node["parent"]] if n["node"] != node["node"])
            way.append((node["center"], other["center"]))
            node = nodes[node["parent"]]
        ways.append((leaf, way))
    off = sum(nodes[parent]["size"] != sum(n["size"] for n in both) for parent, both in sides.items() if parent is not None)
    table = spark.createDataFrame(ways, "leaf int, way array<struct<own: array<double>, other: array<double>>>")
    assigned = model.transform(rows).select("prediction", vector_to_array("features").alias("point"))
    wrong = F.exists("way", lambda split: _squared_distance("point", split["own"]) > _squared_distance("point", split["other"]) + 1e-9)
    counted = assigned.join(F.broadcast(table), F.col("prediction") == F.col("leaf"), "left")
    return counted.agg(
        F.count("*").alias("n_rows"), F.sum(F.coalesce(wrong, F.lit(True)).cast("long")).alias("nearer_other_side")
    ).withColumn("sizes_off", F.lit(off).cast("long"))


def mixture_report_apart(spark: SparkSession, directory: str) -> DataFrame:
    """Weight, means and covariances of two components on two groups apart: those of the groups."""
    model, rows = clustering.fit_gaussian_mixture(_apart(spark, directory), "c_custkey", ["building", "shifted"], k=2, unique_key=True)

    def figure(column, digits):
        return F.round(column, digits) + F.lit(0.0)  # no negative zero

    mean, cov = F.col("mean"), F.col("cov")
    return clustering.gaussians(model, rows).select(
        figure(F.col("weight"), 6).alias("weight"),
        figure(mean[0], 6).alias("mean_building"),
        figure(mean[1], 6).alias("mean_shifted"),
        figure(cov[0], 8).alias("var_building"),
        figure(cov[1], 8).alias("cov_both"),
        figure(cov[3], 8).alias("var_shifted"),
    )


def lda_bounds_hold(spark: SparkSession, directory: str) -> DataFrame:
    """The perplexity's bound is that of the likelihood per token; the tokens of the scaled features are their sum."""
    model, rows = clustering.fit_lda(*catalogue._cluster_args(spark, directory), k=4, max_iter=10, unique_key=True)
    likelihood, perplexity = F.col("log_likelihood"), F.col("log_perplexity")
    return clustering.lda_quality(model, rows).select(F.round(-likelihood / perplexity, 3).alias("n_tokens"), (likelihood < 0).alias("negative"))


def power_iteration(spark: SparkSession, directory: str) -> DataFrame:
    return power_iteration_clusters(*catalogue._cluster_args(spark, directory), k=4)


def power_iteration_apart(spark: SparkSession, directory: str) -> DataFrame:
    return _by_smallest(power_iteration_clusters(_apart(spark, directory), "c_custkey", ["building", "shifted"], k=2))


# Trees with a key that is an empty text


def random_forest_stump_empty_key(spark: SparkSession, directory: str) -> DataFrame:
    lines, key, *rest = catalogue._tree_args(spark, directory)
    lines = lines.withColumn(key, F.when(F.col(key) != "A-F", F.col(key)).otherwise(""))
    return catalogue._accuracy(trees.random_forest(lines, key, *rest, **catalogue.RF_STUMP).metrics)


def gradient_boost_saved(spark: SparkSession, directory: str) -> DataFrame:
    """Children of boosted parents that were saved and loaded again."""
    lines, *rest = catalogue._tree_args(spark, directory)
    workflow = (lines, catalogue._line_clusters(lines), "gradient_boost")
    folder = new_path(spark, "models")
    transfer.ensemble(*workflow, "exhaustive", folder, *rest, grid=catalogue.GBT_STUMP_GRID, folds=2, **catalogue.STUMP)
    return catalogue._rounds(transfer.ensemble(*workflow, "transfer", folder, *rest).history)


def gradient_boost_from_text(spark: SparkSession, directory: str) -> DataFrame:
    """The keys as one text with commas."""
    lines, *rest = catalogue._tree_args(spark, directory)
    kinds = lines.agg(F.array_join(F.sort_array(F.collect_set("line_kind")), ", ")).first()[0]
    return catalogue._rounds(transfer.train_from_first(lines, kinds, *rest, **catalogue.STUMP, max_iter=2).history)


def _whole_grid(spark, directory, kind: str) -> DataFrame:
    """The default grid and folds on all kinds of line: settings scored, settings outside the grid, whether the best is chosen."""
    grid = trees.GRIDS[kind]
    found = forest_search.search_together(kind, *catalogue._tree_args(spark, directory))
    outside = reduce(lambda a, b: a | b, [~F.col("setting")[name].isin([float(v) for v in values]) for name, values in grid.items()])
    chosen = found.chosen.select("line_kind", *[F.col("setting")[name].alias(name) for name in grid])
    is_chosen = reduce(lambda a, b: a & b, [F.col("setting")[name] == F.col(name) for name in grid])
    return found.scores.join(chosen, "line_kind").groupBy("line_kind").agg(
        F.count("*").alias("n_settings"),
        F.count("avg_rmse").alias("n_scored"),
        F.sum(outside.cast("long")).alias("n_outside"),
        (F.min("avg_rmse") * (1 + trees.TIE) >= F.min(F.when(is_chosen, F.col("avg_rmse")))).alias("best_chosen"),
    )


def random_forest_whole_grid(spark: SparkSession, directory: str) -> DataFrame:
    """The name by which the search was known while it took one kind of line."""
    return _whole_grid(spark, directory, "random_forest")


def gradient_boost_whole_grid(spark: SparkSession, directory: str) -> DataFrame:
    """The name by which the search was known while it took one kind of line."""
    return _whole_grid(spark, directory, "gradient_boost")


def random_forest_whole_grid_all_keys(spark: SparkSession, directory: str) -> DataFrame:
    return _whole_grid(spark, directory, "random_forest")


def gradient_boost_whole_grid_all_keys(spark: SparkSession, directory: str) -> DataFrame:
    return _whole_grid(spark, directory, "gradient_boost")


# Tables laid out by key, and file footers


def compound_bucketed(spark: SparkSession, directory: str) -> DataFrame:
    """Customers and their last events, both tables in buckets of the key: nothing is exchanged to join them."""
    events = catalogue._events_side(spark, directory)
    side = Query(by_key(events.rows, "id", 8, events.order_by), events.order_by)
    return catalogue._joined((by_key(catalogue._customers(spark, directory), "id", 8), "left", side))


def count_from_footers(spark: SparkSession, directory: str) -> DataFrame:
    return counts_from_footers(spark, directory, ["lineitem", "region", "nation", "customer", "orders", "customer"])


def bounds_of_lines(spark: SparkSession, directory: str) -> DataFrame:
    return bounds_from_footers(spark, directory, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey"])


# Windows of many rows


def moving_average_long(spark: SparkSession, directory: str) -> DataFrame:
    """Windows of ``LONG_DAYS`` events of a type; runs of rows make them, not a frame per row."""
    events = load_table(spark, directory, "events")
    averages = windows.moving_average(events, "event_type", "ts", "value", LONG_DAYS, "event_id")
    return averages.select("event_type", "ts", "event_id", F.round("avg", 6).alias("avg"))


# Stages sent as JSON


def documents_moving_averages(spark: SparkSession, directory: str) -> DataFrame:
    """The moving averages of every user by a pipeline of JSON documents, the form in which clients ask for them."""
    days = catalogue.DAYS
    averages = {
        "input": {"$range": [0, {"$subtract": [{"$size": "$movingAverages"}, days - 1]}]},
        "as": "i",
        "in": {
            "avg": {"$avg": {"$slice": ["$movingAverages.value", "$$i", days]}},
            "date": {"$arrayElemAt": ["$movingAverages.date", {"$add": ["$$i", days - 1]}]},
        },
    }
    stages = [
        {"$match": {"user_id": {"$ne": None}, "value": {"$ne": None}}},
        {"$sort": {"ts": 1, "event_id": 1}},
        {"$group": {"_id": "$user_id", "movingAverages": {"$push": {"value": "$value", "date": "$ts"}}}},
        {"$addFields": {"numDays": days, "startDate": {"$arrayElemAt": ["$movingAverages.date", 0]}}},
        {"$addFields": {"movingAverages": {"$map": averages}}},
    ]
    answers = run_documents(load_table(spark, directory, "events"), json.dumps(stages))
    entries = answers.select("_id", "numDays", "startDate", F.explode("movingAverages").alias("entry"))
    return entries.select(
        F.col("_id").alias("user_id"), F.lit(0).alias("part"), F.col("numDays").alias("num_days"), F.col("startDate").alias("start_date"),
        F.round("entry.avg", 6).alias("avg"), F.col("entry.date").alias("date"),
    )


# The same answers from trees of all keys grown together


def random_forest_together(spark: SparkSession, directory: str) -> DataFrame:
    return catalogue._accuracy(forest_search.train_together("random_forest", *catalogue._tree_args(spark, directory), **catalogue.RF_STUMP).metrics)


def gradient_boost_together(spark: SparkSession, directory: str) -> DataFrame:
    return catalogue._accuracy(forest_search.train_together("gradient_boost", *catalogue._tree_args(spark, directory), **catalogue.STUMP, max_iter=2).metrics)


def _parents_together(spark, directory, kind: str, **search) -> forest_search.Models:
    lines, *rest = catalogue._tree_args(spark, directory)
    return forest_search.parents_together(lines, catalogue._line_clusters(lines), kind, *rest, **search)


def random_forest_search_together(spark: SparkSession, directory: str) -> DataFrame:
    scores = _parents_together(spark, directory, "random_forest", **catalogue.STUMP_SEARCH["random_forest"]).scores
    return scores.select("line_kind", F.col("setting")["minWeightFractionPerNode"].alias("setting"), catalogue._rounded("avg_rmse", 4))


def gradient_boost_search_together(spark: SparkSession, directory: str) -> DataFrame:
    scores = _parents_together(spark, directory, "gradient_boost", **catalogue.STUMP_SEARCH["gradient_boost"]).scores
    return scores.select("line_kind", F.col("setting")["maxIter"].alias("setting"), catalogue._rounded("avg_rmse", 4))


def random_forest_from_rows(spark: SparkSession, directory: str) -> DataFrame:
    """Parents saved as rows, loaded, and applied to their held-out rows in one plan."""
    lines, key, features, label, row_id = catalogue._tree_args(spark, directory)
    folder = new_path(spark, "models")
    forest_search.save_together(_parents_together(spark, directory, "random_forest", **catalogue.STUMP_SEARCH["random_forest"]), folder)
    nodes = forest_search.load_together(spark, folder).nodes
    held_out = split(lines, 0.8, row_id)[1].withColumn("label", F.col(label).cast("double"))
    rows = predicted(held_out, nodes, key, features).where("prediction IS NOT NULL")
    return catalogue._accuracy(regression_metrics(rows, by=[key]))


def _children_together(spark, directory, kind: str, **search) -> DataFrame:
    """Parents that were saved as rows and loaded; every round of the children is a table."""
    lines, *rest = catalogue._tree_args(spark, directory)
    folder = new_path(spark, "models")
    forest_search.save_together(_parents_together(spark, directory, kind, **search), folder)
    parents = forest_search.load_together(spark, folder)
    history, _, _ = forest_search.children_together(lines, catalogue._line_clusters(lines), parents, kind, *rest, folder)
    return catalogue._rounds(history.withColumn("phase", F.lit("child")))


def random_forest_children_together(spark: SparkSession, directory: str) -> DataFrame:
    """Children of parents whose settings are the best of the default grid, over its folds."""
    return _children_together(spark, directory, "random_forest")


def gradient_boost_children_together(spark: SparkSession, directory: str) -> DataFrame:
    return _children_together(spark, directory, "gradient_boost", **catalogue.STUMP_SEARCH["gradient_boost"])


QUERIES = {
    f.__name__: f
    for f in (
        series_entries,
        series_parts,
        moving_average_entries,
        moving_average_parts,
        moving_average_request_entries,
        moving_average_dirty,
        complete_rows,
        minmax_dirty,
        regression_dirty,
        compound_dirty,
        stats_by_resolution,
        json_and_back,
        huber_of_all_rows,
        iterations_are_reported,
        kmeans_apart,
        bisecting_apart,
        mixture_apart,
        kmeans_holds,
        mixture_holds,
        lda_holds,
        bisecting_holds,
        mixture_report_apart,
        lda_bounds_hold,
        power_iteration,
        power_iteration_apart,
        random_forest_stump_empty_key,
        gradient_boost_saved,
        gradient_boost_from_text,
        random_forest_whole_grid,
        gradient_boost_whole_grid,
        random_forest_whole_grid_all_keys,
        gradient_boost_whole_grid_all_keys,
        compound_bucketed,
        count_from_footers,
        bounds_of_lines,
        moving_average_long,
        documents_moving_averages,
        random_forest_together,
        gradient_boost_together,
        random_forest_search_together,
        gradient_boost_search_together,
        random_forest_from_rows,
        random_forest_children_together,
        gradient_boost_children_together,
    )
}

_ENTRIES = f"({oracles.AVERAGES})"
_STARTED = f"(SELECT *, min(ts) OVER (PARTITION BY user_id) AS start_date FROM {_ENTRIES})"


def _series_sql(part: str, no: str) -> str:
    return f"SELECT user_id, CAST({part} AS INTEGER) AS part, CAST({no} AS INTEGER) AS no, value, ts AS date FROM {_ENTRIES}"


def _averages_sql(part: str) -> str:
    return f"""
        SELECT user_id, CAST({part} AS INTEGER) AS part, 7 AS num_days, start_date, round(average, 6) AS avg, ts AS date
        FROM {_STARTED} WHERE rn >= 7
    """


_APART_SQL = "SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_mktsegment = 'BUILDING') AS smallest FROM customer"
_COMPLETE = f"SELECT count(*) FROM ({oracles.CUSTOMER_FEATURES}) WHERE c_acctbal IS NOT NULL AND n_orders IS NOT NULL AND spend IS NOT NULL"

# Scaled features of the complete customers.
_SCALED_SUM = " + ".join(f"sum(({c} - lo_{c}) / (hi_{c} - lo_{c}))" for c in catalogue.CUSTOMER_FEATURES)
_EXTENTS = ", ".join(f"min({c}) OVER ()::DOUBLE AS lo_{c}, max({c}) OVER ()::DOUBLE AS hi_{c}" for c in catalogue.CUSTOMER_FEATURES)

ORACLES = {
    "series_entries": _series_sql("0", "rn - 1"),
    "series_parts": _series_sql(f"(rn - 1) // {PART_ROWS}", f"(rn - 1) % {PART_ROWS}"),
    "moving_average_entries": _averages_sql("0"),
    "moving_average_parts": _averages_sql(f"(rn - 1) // {PART_ROWS}"),
    "moving_average_request_entries": f"""
        WITH asked AS (
            SELECT user_id, unnest(range(1, count(*) + 1)) AS again
            FROM (SELECT s_suppkey AS user_id FROM supplier UNION ALL SELECT s_nationkey FROM supplier) GROUP BY user_id
        )
        SELECT asked.user_id * 1000 + again AS pos, a.* FROM asked JOIN ({_averages_sql("0")}) a USING (user_id)
    """,
    "moving_average_dirty": """
        WITH clean AS (
            SELECT user_id, ts, event_id, value FROM events
            WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 AND user_id IS NOT NULL AND value IS NOT NULL
        )
        SELECT user_id, ts, event_id, round(average, 6) AS avg FROM (
            SELECT user_id, ts, event_id,
                   avg(value) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS average,
                   row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) AS rn
            FROM clean
        ) WHERE rn >= 7
    """,
    "complete_rows": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_custkey IS NOT NULL AND o_totalprice IS NOT NULL",
    "minmax_dirty": """
        WITH x AS (
            SELECT c_custkey, c_custkey % 7 = 0 AS is_nan, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 THEN c_acctbal END AS v FROM customer
        )
        SELECT c_custkey, CASE WHEN is_nan THEN TRUE ELSE FALSE END AS is_nan,
               round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 9) AS c_acctbal
        FROM x
    """,
    "regression_dirty": """
        WITH rows AS (
            SELECT CASE WHEN l_returnflag = 'A' THEN '' ELSE l_returnflag END AS flag, l_quantity AS x, l_extendedprice AS y
            FROM lineitem WHERE l_orderkey % 7 <> 0 AND l_partkey % 5 <> 0
        ), fits AS (
            SELECT flag, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, var_pop(y) AS spread FROM rows GROUP BY flag
        )
        SELECT flag, round(sqrt(avg((y - a - b * x) ** 2)), 3) AS rmse, round(1 - avg((y - a - b * x) ** 2) / any_value(spread), 8) AS r2,
               round(any_value(a), 2) AS intercept, round(any_value(b), 4) AS slope
        FROM rows JOIN fits USING (flag) GROUP BY flag
    """,
    "compound_dirty": """
        WITH c AS (
            SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS amount FROM customer
        ), s AS (
            SELECT CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey END AS id, s_acctbal AS amount, s_nationkey AS nation FROM supplier
        )
        SELECT CAST(c.id AS DOUBLE) AS id, c.amount, CAST(s.nation AS DOUBLE) AS nation FROM c LEFT JOIN s ON c.id = s.id
        UNION ALL SELECT CAST(s.id AS DOUBLE), s.amount, CAST(s.nation AS DOUBLE) FROM s WHERE s.id IS NULL OR NOT EXISTS (SELECT 1 FROM c WHERE c.id = s.id)
    """,
    "stats_by_resolution": "SELECT n_nationkey, n_name FROM nation",
    "json_and_back": "SELECT p_partkey, p_name, CAST(CASE WHEN p_size >= 10 THEN p_size END AS DOUBLE) AS p_size FROM part",
    "huber_of_all_rows": """
        SELECT CASE WHEN l_returnflag = 'A' THEN '' ELSE l_returnflag END AS flag, round(regr_slope(l_extendedprice, l_quantity), 1) AS slope,
               round(regr_intercept(l_extendedprice, l_quantity), 0) AS intercept
        FROM lineitem GROUP BY 1
    """,
    "iterations_are_reported": "SELECT DISTINCT l_returnflag, TRUE AS whole_history, TRUE AS falling FROM lineitem",
    "kmeans_apart": _APART_SQL,
    "bisecting_apart": _APART_SQL,
    "mixture_apart": _APART_SQL,
    "kmeans_holds": f"SELECT ({_COMPLETE}) AS n_rows, CAST(0 AS BIGINT) AS nearer_elsewhere, CAST(0 AS BIGINT) AS centres_off",
    "mixture_holds": f"SELECT ({_COMPLETE}) AS n_rows, CAST(0 AS BIGINT) AS not_one, CAST(0 AS BIGINT) AS not_likeliest, CAST(1.0 AS DOUBLE) AS weights",
    "bisecting_holds": f"SELECT ({_COMPLETE}) AS n_rows, CAST(0 AS BIGINT) AS nearer_other_side, CAST(0 AS BIGINT) AS sizes_off",
    "mixture_report_apart": """
        WITH points AS (
            SELECT (c_mktsegment = 'BUILDING')::INT::DOUBLE AS building,
                   (c_mktsegment = 'BUILDING')::INT * 2 + c_custkey % 3 * 0.01::DOUBLE AS shifted FROM customer
        ), scaled AS (
            SELECT building, (shifted - min(shifted) OVER ()) / (max(shifted) OVER () - min(shifted) OVER ()) AS shifted, count(*) OVER () AS n FROM points
        )
        SELECT round(count(*) / any_value(n), 6) AS weight, round(avg(building), 6) AS mean_building, round(avg(shifted), 6) AS mean_shifted,
               round(covar_pop(building, building), 8) AS var_building, round(covar_pop(building, shifted), 8) + 0.0 AS cov_both,
               round(covar_pop(shifted, shifted), 8) AS var_shifted
        FROM scaled GROUP BY building
    """,
    "lda_bounds_hold": f"""
        WITH complete AS (
            SELECT *, {_EXTENTS} FROM ({oracles.CUSTOMER_FEATURES}) WHERE c_acctbal IS NOT NULL AND n_orders IS NOT NULL AND spend IS NOT NULL
        )
        SELECT round({_SCALED_SUM}, 3) AS n_tokens, true AS negative FROM complete
    """,
    "power_iteration_apart": _APART_SQL,
    "lda_holds": f"SELECT ({_COMPLETE}) AS n_rows, CAST(0 AS BIGINT) AS not_one, CAST(0 AS BIGINT) AS not_largest",
    "gradient_boost_from_text": oracles.GRADIENT_BOOST_FROM_FIRST,
    "gradient_boost_saved": oracles.GRADIENT_BOOST_TRANSFER,
    **{
        f"{kind}_whole_grid{keys}": f"""
            SELECT DISTINCT l_returnflag || '-' || l_linestatus AS line_kind, CAST({n} AS BIGINT) AS n_settings, CAST({n} AS BIGINT) AS n_scored,
                   CAST(0 AS BIGINT) AS n_outside, TRUE AS best_chosen
            FROM lineitem
        """
        for kind, n in (("random_forest", 81), ("gradient_boost", 27))
        for keys in ("", "_all_keys")
    },
    "compound_bucketed": oracles.COMPOUND_LEFT,
    "count_from_footers": oracles.COUNT_TABLES,
    "bounds_of_lines": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(min({c}) AS VARCHAR) AS low, CAST(max({c}) AS VARCHAR) AS high FROM lineitem"
        for c in ("l_orderkey", "l_partkey", "l_suppkey")
    ),
    "moving_average_long": f"""
        SELECT event_type, ts, event_id, round(average, 6) AS avg FROM (
            SELECT event_type, ts, event_id,
                   avg(value) OVER (PARTITION BY event_type ORDER BY ts NULLS FIRST, event_id ROWS BETWEEN {LONG_DAYS - 1} PRECEDING AND CURRENT ROW) AS average,
                   row_number() OVER (PARTITION BY event_type ORDER BY ts NULLS FIRST, event_id) AS rn
            FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL
        ) WHERE rn >= {LONG_DAYS}
    """,
    "documents_moving_averages": _averages_sql("0"),
    "random_forest_together": oracles.RANDOM_FOREST_STUMP,
    "gradient_boost_together": oracles.GRADIENT_BOOST_STUMPS,
    "random_forest_search_together": oracles.ORACLES["random_forest_exhaustive"],
    "gradient_boost_search_together": oracles.ORACLES["gradient_boost_exhaustive"],
    "random_forest_from_rows": oracles.ORACLES["random_forest_parents"],
    "random_forest_children_together": oracles.RANDOM_FOREST_WHOLE_TRANSFER,
    "gradient_boost_children_together": oracles.GRADIENT_BOOST_TRANSFER,
    "random_forest_stump_empty_key": oracles.RANDOM_FOREST_STUMP.replace(
        "l_returnflag || '-' || l_linestatus AS k",
        "CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN '' ELSE l_returnflag || '-' || l_linestatus END AS k",
    ),
}
