"""Counts, means, per-key summaries and the parent/child groups of a cluster table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.operators.frames import filter_dates, filter_key, quoted
from keyspan.operators.positions import numbered
from keyspan.sources.storage import written
from keyspan.sources.tables import load_table

# Children per array; larger clusters continue in further rows (``part`` 0, 1, ...).
GROUP_CHILDREN = 10_000


def count_tables(spark: SparkSession, directory: str | None, names: list[str], **load) -> DataFrame:
    """Row count of each listed table, in the order of the list: ``(pos, table, count)``."""
    counts = [
        load_table(spark, directory, name, **load)
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.lit(pos).alias("pos"), F.lit(name).alias("table"), "count")
        for pos, name in enumerate(names)
    ]
    if not counts:
        return spark.createDataFrame([], "pos int, table string, count bigint")
    return reduce(DataFrame.unionAll, counts)


def mean_over_dates(
    df: DataFrame, key: str, value, feature: str, date_col: str, start, end
) -> DataFrame:
    """Mean of a feature of one key over a date range: a single row ``(mean)``."""
    rows = filter_dates(filter_key(df, key, value), date_col, start, end)
    return rows.agg(F.avg(quoted(feature)).alias("mean"))


def mean_by_key(df: DataFrame, key: str, feature: str, date_col: str, start, end) -> DataFrame:
    """The same mean for all keys at once: ``(key, mean)``."""
    rows = filter_dates(df, date_col, start, end).where(quoted(key).isNotNull())
    return rows.groupBy(quoted(key)).agg(F.avg(quoted(feature)).alias("mean"))


def key_summary(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Sample standard deviation and mean of every feature per key: ``(key, stddev_<f>, avg_<f>, ...)``."""
    aggs = []
    for f in features:
        aggs += [F.stddev_samp(quoted(f)).alias(f"stddev_{f}"), F.avg(quoted(f)).alias(f"avg_{f}")]
    return df.where(quoted(key).isNotNull()).groupBy(quoted(key)).agg(*aggs)


def cluster_centers_of(clusters: DataFrame, key: str) -> DataFrame:
    """The centre of every cluster that has one: ``(cluster_id, parent, multiple_centers, n_children)``."""
    center = F.when(F.col("is_center"), quoted(key))
    child = F.when(~F.col("is_center"), quoted(key))
    heads = clusters.groupBy("cluster_id").agg(
        F.max(center).alias("parent"),
        (F.min(center) != F.max(center)).alias("multiple_centers"),
        F.count(child).alias("n_children"),
    )
    return heads.where(F.col("parent").isNotNull())


def cluster_members(clusters: DataFrame, key: str) -> DataFrame:
    """One row per child: ``(cluster_id, parent, child)``. Clusters without a centre are left out."""
    children = clusters.where(~F.col("is_center") & quoted(key).isNotNull())
    heads = cluster_centers_of(clusters, key).select("cluster_id", "parent")
    return children.join(heads, "cluster_id").select("cluster_id", "parent", quoted(key).alias("child"))


def cluster_groups(clusters: DataFrame, key: str, group_children: int = GROUP_CHILDREN) -> DataFrame:
    """Children of every centre as sorted arrays: ``(cluster_id, parent, part, children[], multiple_centers)``.

    A centre without children has one empty array. ``part`` counts from 0 within the cluster: the parts, one after the other, are
    the sorted children, and every part but the last has ``group_children`` of them. ``cluster_members`` is the flat form.
    """
    members = clusters.where(F.col("is_center").isNotNull() & quoted(key).isNotNull())
    members = members.select("cluster_id", "is_center", quoted(key).alias("_member"))
    # Written: small, and asked several times.
    heads = written(cluster_centers_of(clusters, key))
    large = heads.where(F.col("n_children") > group_children)
    fitting = heads.where(F.col("n_children") <= group_children).withColumn("part", F.lit(0))
    children = members.where(~F.col("is_center"))
    whole = children.join(large, "cluster_id", "left_anti").withColumn("part", F.lit(0))
    if large.isEmpty():
        parts, pieces = fitting, whole
    else:
        placed = numbered(children.join(large, "cluster_id", "left_semi"), "cluster_id", ["_member"])
        placed = placed.withColumn("part", F.floor(F.col("_position") / group_children).cast("int")).drop("_position")
        last = F.floor((F.col("n_children") - 1) / group_children).cast("int")
        parts = fitting.unionByName(large.withColumn("part", F.explode(F.sequence(F.lit(0), last))))
        pieces = whole.unionByName(placed)
    arrays = pieces.groupBy("cluster_id", "part").agg(F.array_sort(F.collect_list("_member")).alias("children"))
    empty = F.array().cast(arrays.schema["children"].dataType)
    return parts.join(arrays, ["cluster_id", "part"], "left").select(
        "cluster_id", "parent", "part", F.coalesce("children", empty).alias("children"), "multiple_centers"
    )
