import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from keyspan.models import clustering
from keyspan.models.components import components_for, components_for_variance, explained_variance

FEATURES = ["c_acctbal", "c_nationkey"]
METHODS = {
    "kmeans": clustering.kmeans,
    "bisecting": clustering.bisecting_kmeans,
    "mixture": clustering.gaussian_mixture,
    "lda": clustering.lda,
}


@pytest.fixture(scope="module")
def customers(spark, small_dir):
    df = spark.read.parquet(f"{small_dir}/customer.parquet").select("c_custkey", *FEATURES)
    holes = spark.createDataFrame([(-1, None, 3), (None, 5.0, 3)], df.schema)
    return df.unionAll(holes)


@pytest.mark.parametrize("name", METHODS)
def test_every_complete_row_gets_a_cluster(customers, name):
    got = METHODS[name](customers, "c_custkey", FEATURES, k=3, max_iter=5).collect()
    assert sorted(r["c_custkey"] for r in got) == list(range(len(got))) and len(got) == customers.count() - 2
    assert {r["prediction"] for r in got} <= {0, 1, 2}


@pytest.mark.parametrize("name", METHODS)
def test_same_seed_same_clusters(customers, name):
    settings = dict(k=3, max_iter=5, seed=7, unique_key=True)
    first = METHODS[name](customers, "c_custkey", FEATURES, **settings)
    again = METHODS[name](customers.repartition(5), "c_custkey", FEATURES, **settings)
    columns = ["c_custkey", "prediction"]
    assert sorted(map(tuple, first.select(columns).collect())) == sorted(map(tuple, again.select(columns).collect()))


@pytest.mark.parametrize("name", METHODS)
@pytest.mark.parametrize("k", [0, 1])
def test_too_few_clusters(customers, name, k):
    with pytest.raises(ValueError):
        METHODS[name](customers, "c_custkey", FEATURES, k=k)


def test_kmeans_assigns_to_the_nearest_reported_center(customers):
    model, rows = clustering.fit_kmeans(customers, "c_custkey", FEATURES, k=4)
    centers = {r["cluster"]: r["center"] for r in clustering.cluster_centers(model, rows).collect()}
    assert set(centers) == {0, 1, 2, 3}
    assigned = model.transform(rows).select("prediction", vector_to_array("features").alias("x")).collect()

    def nearest(x):
        return min(centers, key=lambda c: sum((a - b) ** 2 for a, b in zip(x, centers[c])))

    assert all(nearest(r["x"]) == r["prediction"] for r in assigned) and len(assigned) == rows.count()


def test_sides_of_a_split_add_up_before_it_settles(customers):
    # One iteration settles nothing: what Spark saves are the sizes before the rows were dealt by the last centres.
    model, rows = clustering.fit_bisecting_kmeans(customers, "c_custkey", FEATURES, k=6, max_iter=1)
    nodes = {r["node"]: r for r in clustering.split_tree(model, rows).collect()}
    leaves = {r["prediction"]: r["n"] for r in model.transform(rows).groupBy("prediction").agg(F.count("*").alias("n")).collect()}
    for node, r in nodes.items():
        sides = [n["size"] for n in nodes.values() if n["parent"] == node]
        assert r["size"] == (sum(sides) if sides else leaves[node])
    assert sum(r["parent"] is None for r in nodes.values()) == 1 and all(r["cost"] >= 0 for r in nodes.values())


def test_mixture_report(customers):
    model, rows = clustering.fit_gaussian_mixture(customers, "c_custkey", FEATURES, k=3, max_iter=5)
    got = clustering.gaussians(model, rows).collect()
    assert sum(r["weight"] for r in got) == pytest.approx(1.0)
    assert all(len(r["mean"]) == 2 and len(r["cov"]) == 4 for r in got)


def test_lda(customers):
    got = clustering.lda(customers, "c_custkey", FEATURES, k=3, max_iter=5).collect()
    for r in got:
        assert sum(r["topic_distribution"]) == pytest.approx(1.0)
        assert r["topic_distribution"][r["prediction"]] == max(r["topic_distribution"])
    model, rows = clustering.fit_lda(customers, "c_custkey", FEATURES, k=3, max_iter=5)
    quality = clustering.lda_quality(model, rows).first()
    assert quality["log_likelihood"] < 0 < quality["log_perplexity"]


def test_principal_components(spark):
    rows = [(float(i), 2.0 * i + (i % 3), float(i * 7 % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    shares = explained_variance(df, ["a", "b", "c"], 3)
    assert sum(shares) == pytest.approx(1.0) and shares == sorted(shares, reverse=True)
    assert components_for_variance(df, ["a", "b", "c"], 3) == 1
    assert components_for_variance(df, ["a", "b", "c"], 3, target=1.1) == 3
    assert components_for([0.6, 0.3, 0.1], 0.9 - 1e-12) == 2 and components_for([0.5, 0.2], 0.95) == 2
