"""Power iteration clustering over the cells of a grid.

The affinities of all pairs of rows grow with the square of the rows. Here the scaled features are cut into a grid; the rows of a
cell, similar among each other, are one point with a weight, and only cells that touch are similar. A cell and its neighbours meet
by an equi-join on the cell's number, so no two rows are ever paired and the graph is bounded by the grid, not by the table; a cell
with a third of all rows is a row of the graph like any other. Spark ML's power iteration then clusters the graph.

A cell is dealt into three vertices that are linked with one another: its rows are similar to each other whether or not a
neighbouring cell is occupied, and a group of one cell is a group. The weights are those of all pairs of rows summed: the number of
pairs times the similarity of the cells' means.

Defined cases: rows with a null take no part. Every other row has a prediction. A constant feature puts all rows into the middle
cell. Without rows the answer is empty.
"""

from __future__ import annotations

from itertools import product

from pyspark.ml.clustering import PowerIterationClustering
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.models.clustering import check_k, prepared
from keyspan.operators.frames import quoted
from keyspan.sources.storage import written

# Cells along a feature.
CELLS = 10
# Every cell has 3 ** features - 1 neighbours: tables of more features are projected first (``components_for_variance``).
MOST_FEATURES = 7
VERTICES = 3


def _cell(point, n_features: int, cells: int):
    """The number of the cell of a scaled ``point``: its places along the features as digits."""
    places = [F.least(F.floor(point[i] * cells), F.lit(cells - 1)) for i in range(n_features)]
    return sum((p * F.lit(cells**i) for i, p in enumerate(places)), F.lit(0).cast("long"))


def grid_cells(rows: DataFrame, n_features: int, cells: int = CELLS) -> DataFrame:
    """``(cell, n, mean[])`` of the occupied cells of ``rows``, which have a scaled ``point``."""
    means = F.array(*(F.avg(F.col("point")[i]) for i in range(n_features)))
    return rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), means.alias("mean"))


def neighbours(occupied: DataFrame, n_features: int, cells: int = CELLS) -> DataFrame:
    """``(src, dst, weight)`` of each pair of occupied cells that touch, once: rows of both times the similarity of their means."""
    # Of each direction and its opposite one is enough; the last feature that differs goes up.
    ways = [way for way in product((-1, 0, 1), repeat=n_features) if next((w for w in reversed(way) if w), 0) > 0]
    place = [F.pmod(F.floor(F.col("cell") / F.lit(cells**i)), F.lit(cells)) for i in range(n_features)]
    inside = [[(place[i] + w).between(0, cells - 1) for i, w in enumerate(way) if w] for way in ways]
    steps = []
    for way, checks in zip(ways, inside, strict=True):
        fits = checks[0]
        for check in checks[1:]:
            fits = fits & check
        steps.append(F.when(fits, F.lit(sum(w * cells**i for i, w in enumerate(way))).cast("long")))
    asked = occupied.select(
        F.col("cell").alias("src"), F.col("n").alias("n_src"), F.col("mean").alias("mean_src"), F.explode(F.filter(F.array(*steps), lambda s: s.isNotNull())).alias("step")
    ).withColumn("dst", F.col("src") + F.col("step"))
    found = asked.join(occupied.select(F.col("cell").alias("dst"), "n", "mean"), "dst")
    squares = F.zip_with("mean_src", "mean", lambda a, b: (a - b) * (a - b))
    distance = F.aggregate(squares, F.lit(0.0), lambda a, b: a + b) * (cells * cells)
    return found.select("src", "dst", (F.col("n_src").cast("double") * F.col("n") * F.exp(-distance / 2)).alias("weight"))


def _graph(occupied: DataFrame, n_features: int, cells: int) -> DataFrame:
    """Edges between vertices: three per cell, linked among each other, and each with its like in the cells that touch."""
    own = F.col("cell") * VERTICES
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (0, 2), (1, 2))))
    within = occupied.select(own.alias("own"), (F.col("n").cast("double") * F.col("n")).alias("weight"), F.explode(pairs).alias("pair"))
    within = within.select((F.col("own") + F.col("pair.a")).alias("src"), (F.col("own") + F.col("pair.b")).alias("dst"), "weight")
    # A vertex has two of its cell's links and one to each neighbour.
    between = neighbours(occupied, n_features, cells).select("*", F.explode(F.sequence(F.lit(0), F.lit(VERTICES - 1))).alias("no"))
    between = between.select(*((F.col(c) * VERTICES + F.col("no")).alias(c) for c in ("src", "dst")), (F.col("weight") * 2).alias("weight"))
    return within.union(between)


def power_iteration(
    df: DataFrame, key: str, features: list[str], k: int, max_iter: int = 20, cells: int = CELLS, init_mode: str = "degree"
) -> DataFrame:
    """``(key, prediction)`` by power iteration clustering of the rows' cells.

    The start by degree gives the same clusters again; groups of the very same shape, with as many rows, need ``init_mode="random"``.
    """
    check_k(k, 2)
    if not 0 < len(features) <= MOST_FEATURES:
        raise ValueError(f"power iteration takes 1 to {MOST_FEATURES} features, not {len(features)}: project them first")
    if cells < 2 or VERTICES * cells ** len(features) >= 2**52:
        raise ValueError(f"cells along a feature: at least 2 and fewer than 2**52 vertices in all, not {cells}")
    rows, n_rows = prepared(df, key, features)
    points = rows.select(quoted(key), vector_to_array("features").alias("point"))
    placed = points.select(quoted(key).alias("_key"), "point").withColumn("cell", _cell(F.col("point"), len(features), cells))
    if n_rows == 0:
        return placed.select(F.col("_key").alias(key), F.lit(None).cast("int").alias("prediction"))
    occupied = written(grid_cells(placed, len(features), cells))
    graph = written(_graph(occupied, len(features), cells))
    operator = PowerIterationClustering(k=k, maxIter=max_iter, initMode=init_mode, srcCol="src", dstCol="dst", weightCol="weight")
    clusters = operator.assignClusters(graph).where(F.col("id") % VERTICES == 0)
    named = clusters.select((F.col("id") / VERTICES).cast("long").alias("cell"), F.col("cluster").alias("prediction"))
    return placed.join(written(named), "cell").select(F.col("_key").alias(key), "prediction")
