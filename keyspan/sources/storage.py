"""The folder all executors share: tables written in between, and tables laid out by key."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only for a local session that has none."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="keyspan-"))
        current = sc.getCheckpointDir()
    return current


# Paths made inside the innermost ``scratch`` block.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_path(spark: SparkSession, purpose: str) -> str:
    """A path in the shared folder that nobody else uses. The ``scratch`` block around the call, if any, removes it."""
    path = f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Owner of what is written to the shared folder inside the block: consume the answers there, on exit the files go.

    Without such a block files stay, like those of a checkpoint, for as long as the folder's owner keeps them.
    """
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            remove(spark, path)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder and go on from there: computed once, survives lost executors."""
    path = new_path(df.sparkSession, "written")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop_path(spark: SparkSession, path: str):
    """The one place that reaches for the JVM: Spark has no other way to look at or remove files."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _hadoop_path(spark, path)
    return fs.exists(hadoop_path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop_path, fs = _hadoop_path(spark, path)
    fs.delete(hadoop_path, True)


# Name of the folders of a table laid out by key: no key gives an empty text here, which Spark would store as null.
FOLDER = "_folder"


def _folder(key: Column) -> Column:
    return F.concat(F.lit("key="), key.cast("string"))


def rows_with_key(staged: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key of a table from ``staged_by_key``; other keys' folders are not read."""
    wanted = F.lit(value).cast(staged.schema[key].dataType)
    return staged.where((F.col(FOLDER) == _folder(wanted)) & (F.col(f"`{key}`") == wanted)).drop(FOLDER)


@contextmanager
def staged_by_key(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """``df`` and the column ``_folder`` as a table with a folder per ``key``, removed again on exit; see ``rows_with_key``.

    Model fits per key then read their own folder only, however many keys there are. ``rebalance`` keeps the rows of a
    small key together and, with adaptive execution, splits a large one over several tasks, so a key holding most of the rows
    is no bottleneck. The key itself stays in the rows: a folder's name is not read back as a value. Rows without a key are left out.
    """
    spark = df.sparkSession
    path = new_path(spark, "staged")
    column = F.col(f"`{key}`")
    rows = df.where(column.isNotNull()).withColumn(FOLDER, _folder(column))
    rows.hint("rebalance", FOLDER).write.partitionBy(FOLDER).parquet(path)
    try:
        yield spark.read.schema(rows.schema).parquet(path)
    finally:
        remove(spark, path)
