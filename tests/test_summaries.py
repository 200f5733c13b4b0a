import datetime as dt

import pytest

from keyspan.operators import summaries
from keyspan.sources import load_clusters

CLUSTERS = [
    (1, "G01", True), (1, "G02", False), (1, "G03", False),
    (2, "G04", False),
    (3, "G05", True),
    (4, "G06", True), (4, "G07", True), (4, "G08", False),
    (5, None, True), (5, "G09", False),
]


@pytest.fixture
def clusters(spark):
    return spark.createDataFrame(CLUSTERS, "cluster_id int, gis_join string, is_center boolean")


def test_cluster_groups(clusters):
    got = {r["cluster_id"]: r for r in summaries.cluster_groups(clusters, "gis_join").collect()}
    assert {c: (r["parent"], r["children"], r["multiple_centers"]) for c, r in got.items()} == {
        1: ("G01", ["G02", "G03"], False),
        3: ("G05", [], False),
        4: ("G07", ["G08"], True),
    }


def test_large_clusters_are_spread(spark):
    rows = [(1, 0, True)] + [(1, n, False) for n in range(1, 301)]
    clusters = spark.createDataFrame(rows, "cluster_id int, k int, is_center boolean")
    got = summaries.cluster_groups(clusters, "k", group_children=50).collect()
    assert len(got) == 6 and {r["part"] for r in got} == set(range(6))
    assert sorted(c for r in got for c in r["children"]) == list(range(1, 301))
    # One after the other the parts are the sorted children, in every part but the last as many as asked for.
    assert [r["children"] for r in sorted(got, key=lambda r: r["part"])] == [list(range(n, n + 50)) for n in range(1, 301, 50)]


def test_copies_of_a_member_are_spread_too(spark):
    rows = [(1, 0, True)] + [(1, 7, False)] * 95 + [(1, n, False) for n in range(1, 6)]
    clusters = spark.createDataFrame(rows, "cluster_id int, k int, is_center boolean")
    got = summaries.cluster_groups(clusters, "k", group_children=10).collect()
    assert sorted(c for r in got for c in r["children"]) == sorted([7] * 95 + [1, 2, 3, 4, 5])
    assert max(len(r["children"]) for r in got) <= 15


def test_cluster_members(clusters):
    got = sorted(tuple(r) for r in summaries.cluster_members(clusters, "gis_join").collect())
    assert got == [(1, "G01", "G02"), (1, "G01", "G03"), (4, "G07", "G08")]


def test_cluster_file(spark, tmp_path):
    path = tmp_path / "clusters.csv"
    path.write_text("cluster_id,gis_join,is_center\n31,G3000710,true\n31,G3000850,false\n31,G3800870,false\n")
    got = summaries.cluster_groups(load_clusters(spark, str(path)), "gis_join").first()
    assert (got["cluster_id"], got["parent"], got["children"]) == (31, "G3000710", ["G3000850", "G3800870"])


def test_counts_in_request_order(spark, small_dir):
    got = summaries.count_tables(spark, small_dir, ["nation", "region", "nation"]).orderBy("pos").collect()
    assert [(r["table"], r["count"]) for r in got] == [("nation", 25), ("region", 5), ("nation", 25)]
    assert summaries.count_tables(spark, small_dir, []).count() == 0


def test_mean_over_dates(spark):
    rows = [("a", dt.datetime(2020, 1, d, h), float(d)) for d in range(1, 6) for h in (0, 12)]
    rows.append(("b", dt.datetime(2020, 1, 2), 50.0))
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, v double")
    bounds = ("2020-01-02 00:00:00.000 +0000", "2020-01-04 00:00:00.000 +0000")
    # The end bound is the midnight that begins the day: 4 January counts once.
    assert summaries.mean_over_dates(df, "k", "a", "v", "at", *bounds).first()["mean"] == (2 + 2 + 3 + 3 + 4) / 5
    got = {r["k"]: r["mean"] for r in summaries.mean_by_key(df, "k", "v", "at", *bounds).collect()}
    assert got == {"a": 2.8, "b": 50.0}
    assert summaries.mean_over_dates(df, "k", "none", "v", "at", *bounds).first()["mean"] is None


def test_key_summary(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 5.0), (None, 1.0)], "k string, v double")
    got = {r["k"]: (r["stddev_v"], r["avg_v"]) for r in summaries.key_summary(df, "k", ["v"]).collect()}
    assert got["a"] == (pytest.approx(2**0.5), 2.0)
    assert got["b"] == (None, 5.0) and set(got) == {"a", "b"}
