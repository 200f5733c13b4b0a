"""Tables laid out for what is asked of them again and again: rows by key in buckets, counts and bounds from file footers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.operators.frames import quoted
from keyspan.sources.storage import new_path

# Whole numbers and dates: their smallest and largest value in a Parquet footer are exact. (Text is cut there, NaN is left out.)
EXACT = ("tinyint", "smallint", "int", "bigint", "date")


def by_key(df: DataFrame, key: str, buckets: int, order: list[str] | None = None, path: str | None = None) -> DataFrame:
    """``df`` as a table with ``buckets`` buckets of ``key``, rows within them sorted by ``key`` and ``order``.

    Grouping, windows and joins on the key need no exchange of such tables, and joins none where both have as many buckets. One shuffle
    now for all of these later. Without a ``path`` the files are in the shared folder. A key with very many rows fills its bucket: take a
    layout by key for tables whose keys are of bounded size, and leave others to adaptive execution.
    """
    name = f"keyspan_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, quoted(key))
    writer = rows.write.format("parquet").bucketBy(buckets, key).sortBy(key, *(order or ()))
    writer.option("path", path or new_path(df.sparkSession, "bucketed")).saveAsTable(name)
    return df.sparkSession.table(name)


def _footers(spark: SparkSession) -> SparkSession:
    """A session over the same catalogue whose Parquet reader answers counts and bounds from footers."""
    session = spark.newSession()
    sources = [s for s in session.conf.get("spark.sql.sources.useV1SourceList").split(",") if s.strip() != "parquet"]
    session.conf.set("spark.sql.sources.useV1SourceList", ",".join(sources))
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return session


def counts_from_footers(spark: SparkSession, directory: str, names: list[str]) -> DataFrame:
    """``count_tables`` of Parquet tables without reading a row: ``(pos, table, count)``."""
    session = _footers(spark)
    out = session.createDataFrame([], "pos int, table string, count bigint")
    for pos, name in enumerate(names):
        counted = session.read.parquet(f"{directory.rstrip('/')}/{name}.parquet").agg(F.count(F.lit(1)).alias("count"))
        out = out.unionAll(counted.select(F.lit(pos), F.lit(name), "count"))
    return out


def bounds_from_footers(spark: SparkSession, directory: str, name: str, columns: list[str]) -> DataFrame:
    """``(column, low, high)`` of whole numbers and dates, as text, from the footers of a Parquet table."""
    table = _footers(spark).read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
    wrong = [c for c in columns if table.schema[c].dataType.simpleString() not in EXACT]
    if wrong or not columns:
        raise ValueError(f"footers have exact bounds of {EXACT} only, not of {wrong}")
    edges = [f(quoted(c)).alias(f"{side}{i}") for i, c in enumerate(columns) for side, f in (("low", F.min), ("high", F.max))]
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"low{i}").cast("string").alias("low"), F.col(f"high{i}").cast("string").alias("high")) for i, c in enumerate(columns)]
    return table.agg(*edges).select(F.inline(F.array(*rows)))
