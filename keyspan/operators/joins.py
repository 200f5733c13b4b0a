"""Joining several query results on the key, and children with their parents."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.operators.frames import quoted
from keyspan.operators.summaries import cluster_members

JOINS = {"inner": "inner", "outer": "full", "full": "full", "left": "left", "right": "right"}
NO_PARENT = "none"


@dataclass(frozen=True)
class Query:
    """A query result that may hold several rows per key, and the order in which the last of them wins."""

    rows: DataFrame
    order_by: list[str]


def dedupe_last(df: DataFrame, key: str, order_by: list[str], keep_null_keys: bool = True) -> DataFrame:
    """The last row of every key in the order of ``order_by``, which should leave no ties.

    An aggregate, not a window: every task reduces its rows before the shuffle, so a key with very many rows costs no more
    than any other. Rows without a key belong to no group; they are all kept, or all dropped.
    """
    others = [c for c in df.columns if c != key]
    payload = F.struct(*[quoted(c) for c in others])
    rank = F.struct(*[quoted(c) for c in order_by])
    last = (
        df.where(quoted(key).isNotNull())
        .groupBy(quoted(key))
        .agg(F.max_by(payload, rank).alias("_last"))
        .select(quoted(key), "_last.*")
        .select(*[quoted(c) for c in df.columns])
    )
    if not keep_null_keys:
        return last
    return last.unionByName(df.where(quoted(key).isNull()))


def _join_kind(how: str) -> str:
    if how not in JOINS:
        raise ValueError(f"unknown join {how!r}, expected one of {tuple(JOINS)}")
    return JOINS[how]


def compound_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join two results with one row per key; where both have a column, the left row's value stands, even a null.

    Rows that only the right side has keep their own values. Null keys match nothing.
    """
    kind = _join_kind(how)
    shared = [c for c in right.columns if c in left.columns and c != key]
    left_columns = [c for c in left.columns if c != key]
    right_columns = [c for c in right.columns if c != key and c not in shared]
    if kind in ("inner", "left"):
        return left.join(right.drop(*shared), key, kind).select(
            quoted(key), *[quoted(c) for c in left_columns + right_columns]
        )
    marked = left.withColumn("_in_left", F.lit(True))
    both = marked.join(right.withColumnsRenamed({c: f"_right_{c}" for c in shared}), key, kind)
    merged = [
        F.when(F.col("_in_left"), quoted(c)).otherwise(quoted(f"_right_{c}")).alias(c) if c in shared else quoted(c)
        for c in left_columns
    ]
    return both.select(quoted(key), *merged, *[quoted(c) for c in right_columns])


def _evaluate(node, key: str) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of ``node`` that have a key, and the frames of those that have none.

    Rows without a key match nothing. Kept out of the joins, they cannot pile up in the task that null keys hash to.
    """
    if isinstance(node, DataFrame):
        return node.where(quoted(key).isNotNull()), [node.where(quoted(key).isNull())]
    if isinstance(node, Query):
        last = dedupe_last(node.rows, key, node.order_by, keep_null_keys=False)
        return last, [node.rows.where(quoted(key).isNull())]
    if len(node) == 1:
        return _evaluate(node[0], key)
    left, how, right = (node[0], "inner", node[1]) if len(node) == 2 else node
    kind = _join_kind(how)
    left_rows, left_orphans = _evaluate(left, key)
    right_rows, right_orphans = _evaluate(right, key)
    orphans = (left_orphans if kind in ("left", "full") else []) + (
        right_orphans if kind in ("right", "full") else []
    )
    return compound_join(left_rows, right_rows, key, how), orphans


def compound(node, key: str) -> DataFrame:
    """A tree of queries joined on the key.

    ``node`` is a DataFrame with one row per key, a ``Query``, or a tuple ``(node,)``, ``(node, node)`` or
    ``(node, how, node)``. Rows without a key stay where the join keeps unmatched rows of their side.
    """
    rows, orphans = _evaluate(node, key)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), orphans, rows)


def with_parent(rows: DataFrame, clusters: DataFrame, key: str, parent: str = "parent") -> DataFrame:
    """Add the parent of each row's key, ``none`` for keys that are nobody's child.

    ``clusters`` is ``(cluster_id, key, is_center)``.
    """
    parents = (
        cluster_members(clusters, key)
        .groupBy(F.col("child").alias(key))
        .agg(F.max("parent").alias(parent))
    )
    joined = rows.join(parents, key, "left")
    return joined.withColumn(parent, F.coalesce(F.col(parent).cast("string"), F.lit(NO_PARENT)))
