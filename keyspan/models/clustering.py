"""Clustering recipes: drop incomplete rows, scale the features to [0, 1], fit, and assign a cluster to every key.

Where the key names a single row, ``unique_key`` lays the rows out by it, and the same seed gives the same clusters again. With
repeated keys that layout could put most rows into one task, so it is not the default.
"""

from __future__ import annotations

from pyspark.ml.clustering import LDA, BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.functions.scaling import scaled_vectors
from keyspan.models.layout import laid_out
from keyspan.operators.frames import drop_incomplete, quoted, select_columns
from keyspan.sources.storage import new_path, written


def prepared(df: DataFrame, key: str, features: list[str]) -> tuple[DataFrame, int]:
    """``(key, features)`` with the scaled feature vector, rows with a null left out, and their number.

    The rows are written once: bounds, fit and assignment read them, not what they were computed from.
    """
    rows = drop_incomplete(select_columns(df, key, features), [key, *features])
    # Under other names, so that a feature may itself be called ``features``.
    inputs = [f"_f{i}" for i in range(len(features))]
    rows = rows.select(quoted(key), *[quoted(c).alias(i) for c, i in zip(features, inputs)])
    return scaled_vectors(written(rows), inputs)


def check_k(k: int, at_least: int) -> None:
    if k < at_least:
        raise ValueError(f"cluster count must be at least {at_least}, not {k}")


def _fit(estimator, df: DataFrame, key: str, features: list[str], unique_key: bool):
    """The fitted model and the rows it was fitted on. The iterations read the prepared rows from memory or disk."""
    rows, n_rows = prepared(df, key, features)
    training = (laid_out(rows, n_rows, [key]) if unique_key else rows).persist()
    try:
        model = estimator.fit(training)
    finally:
        training.unpersist()
    return model, rows


def fit_kmeans(df, key, features, k, max_iter=20, seed=1, unique_key=False):
    check_k(k, 2)
    return _fit(KMeans(k=k, maxIter=max_iter, seed=seed), df, key, features, unique_key)


def fit_bisecting_kmeans(df, key, features, k, max_iter=20, seed=1, unique_key=False):
    check_k(k, 2)
    return _fit(BisectingKMeans(k=k, maxIter=max_iter, seed=seed), df, key, features, unique_key)


def fit_gaussian_mixture(df, key, features, k, max_iter=100, seed=1, unique_key=False):
    check_k(k, 2)
    return _fit(GaussianMixture(k=k, maxIter=max_iter, seed=seed), df, key, features, unique_key)


def fit_lda(df, key, features, k, max_iter=20, seed=1, unique_key=False):
    check_k(k, 2)
    return _fit(LDA(k=k, maxIter=max_iter, seed=seed), df, key, features, unique_key)


def kmeans(
    df: DataFrame, key: str, features: list[str], k: int, max_iter: int = 20, seed: int = 1, unique_key: bool = False
) -> DataFrame:
    """``(key, prediction)`` by k-means."""
    model, rows = fit_kmeans(df, key, features, k, max_iter, seed, unique_key)
    return model.transform(rows).select(quoted(key), "prediction")


def bisecting_kmeans(
    df: DataFrame, key: str, features: list[str], k: int, max_iter: int = 20, seed: int = 1, unique_key: bool = False
) -> DataFrame:
    """``(key, prediction)`` by bisecting k-means."""
    model, rows = fit_bisecting_kmeans(df, key, features, k, max_iter, seed, unique_key)
    return model.transform(rows).select(quoted(key), "prediction")


def gaussian_mixture(
    df: DataFrame, key: str, features: list[str], k: int, max_iter: int = 100, seed: int = 1, unique_key: bool = False
) -> DataFrame:
    """``(key, prediction)``, the most probable component of a Gaussian mixture."""
    model, rows = fit_gaussian_mixture(df, key, features, k, max_iter, seed, unique_key)
    return model.transform(rows).select(quoted(key), "prediction")


def lda(
    df: DataFrame, key: str, features: list[str], k: int, max_iter: int = 20, seed: int = 1, unique_key: bool = False
) -> DataFrame:
    """``(key, prediction, topic_distribution[])`` by latent Dirichlet allocation; the prediction is the largest topic."""
    model, rows = fit_lda(df, key, features, k, max_iter, seed, unique_key)
    topics = model.transform(rows).select(quoted(key), vector_to_array("topicDistribution").alias("topic_distribution"))
    largest = F.array_position("topic_distribution", F.array_max("topic_distribution")) - 1
    return topics.select(quoted(key), largest.cast("int").alias("prediction"), "topic_distribution")


def cluster_centers(model, df: DataFrame) -> DataFrame:
    """``(cluster, center[])`` of a k-means or bisecting k-means model, in scaled feature space."""
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return df.sparkSession.createDataFrame(rows, "cluster int, center array<double>")


def split_tree(model, df: DataFrame) -> DataFrame:
    """``(node, parent, size, cost, center[])`` of a bisecting k-means model: every cluster it had, from the root (no parent) on.

    ``size`` counts the rows of ``df`` (with their ``features``) that the model leads through a node, and ``cost`` is the sum of their squared
    distances to its centre. The sizes Spark saves are older than the last centres, so where a split did not settle in ``max_iter``
    its sides don't add up. The tree itself is read from the model as Spark saves it.
    """
    path = new_path(df.sparkSession, "bisecting")
    model.write().save(path)
    saved = df.sparkSession.read.parquet(f"{path}/data/data")
    # Two nodes for each of the clusters asked for at most.
    nodes = {r["index"]: r for r in saved.select("index", "children", vector_to_array("center").alias("center")).collect()}
    above = {child: node for node, r in nodes.items() for child in r["children"]}
    ways = []
    for leaf in (n for n, r in nodes.items() if not r["children"]):
        node = leaf
        while node is not None:
            ways.append((leaf, node, nodes[node]["center"]))
            node = above.get(node)
    way = F.broadcast(df.sparkSession.createDataFrame(ways, "prediction int, node long, center array<double>"))
    assigned = model.transform(df).select("prediction", vector_to_array("features").alias("point"))
    distance = F.aggregate(F.zip_with("point", "center", lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda a, b: a + b)
    counted = assigned.join(way, "prediction").groupBy("node").agg(F.count("*").alias("size"), F.sum(distance).alias("cost"))
    known = df.sparkSession.createDataFrame(
        [(n, above.get(n), r["center"]) for n, r in nodes.items()], "node long, parent long, center array<double>"
    )
    none = {"size": F.coalesce("size", F.lit(0).cast("long")), "cost": F.coalesce("cost", F.lit(0.0))}
    return known.join(F.broadcast(counted), "node", "left").withColumns(none).select("node", "parent", "size", "cost", "center")


def gaussians(model, df: DataFrame) -> DataFrame:
    """``(component, weight, mean[], cov[])`` of a mixture; the covariance matrix row by row."""
    rows = [
        (i, float(w), [float(x) for x in g.mean.toArray()], [float(x) for x in g.cov.toArray().ravel()])
        for i, (w, g) in enumerate(zip(model.weights, model.gaussians))
    ]
    return df.sparkSession.createDataFrame(
        rows, "component int, weight double, mean array<double>, cov array<double>"
    )


def lda_quality(model, rows: DataFrame) -> DataFrame:
    """``(log_likelihood, log_perplexity)``, the bounds of an LDA model on the rows."""
    figures = (float(model.logLikelihood(rows)), float(model.logPerplexity(rows)))
    return rows.sparkSession.createDataFrame([figures], "log_likelihood double, log_perplexity double")
