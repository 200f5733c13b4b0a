"""Tables between two steps of an operator, written once to the folder that all executors share, and the code they run."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

import keyspan
from pyspark.sql import DataFrame, SparkSession

from keyspan.sources.storage import new_path

# While a table is written: Spark removes the shuffle files as soon as the query has ended, instead of when the driver collects its
# garbage, and hands rows to Python in batches that stay small beside an executor's memory.
SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors' Python workers, which need not have it installed; once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        folder = Path(keyspan.__file__).parent
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='keyspan-')}/keyspan", "zip", folder.parent, folder.name))
        _shipped.add(sc.applicationId)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: computed once, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, "llm")
    before = {name: spark.conf.get(name) for name in SETTINGS}
    try:
        for name, value in SETTINGS.items():
            spark.conf.set(name, value)
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)
