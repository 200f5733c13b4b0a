"""Connected components of a graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.llm.staging import staged


def connected(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a, b``): the smallest node that it reaches.

    Nodes are tied to ever smaller neighbours, alternately to larger and to smaller ones, until nothing changes; the rounds follow the
    logarithm of the longest path. Each round's links are written to the shared folder.
    """
    links = staged(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("least"))
        # The smallest of a node and its neighbours, handed to the larger neighbours.
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
        large = large.where("a != b").distinct()
        # Then handed to the node and its smaller neighbours.
        lower = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).union(lower)
        links = staged(small.where("a != b").distinct())
        now = tuple(links.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
        links.select("b", F.col("b").alias("component")).distinct()
    )
