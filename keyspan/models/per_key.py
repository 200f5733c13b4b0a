"""Running one Spark ML fit per key."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from keyspan.operators.frames import quoted


def distinct_keys(rows: DataFrame, key: str) -> list:
    """The keys to train a model for, in order. One model per key: a list the driver has to hold anyway, streamed to it."""
    found = rows.select(quoted(key)).where(quoted(key).isNotNull()).distinct()
    return sorted(r[0] for r in found.toLocalIterator())


def fit_each_key(spark: SparkSession, keys: list, fit: Callable, parallelism: int = 4) -> list:
    """``fit(key)`` for every key, a few at a time, so that the jobs of one fill the gaps of another."""
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(keys) or 1))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(fit), keys))
