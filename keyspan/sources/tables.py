"""Named collections as DataFrames, and result rows as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CLUSTER_SCHEMA = "cluster_id int, gis_join string, is_center boolean"

# The spatial levels a request may name.
RESOLUTIONS = ("state", "county", "tract", "block")


def load_table(
    spark: SparkSession,
    directory: str | None,
    name: str,
    fmt: str = "parquet",
    schema: str | None = None,
    options: dict[str, str] | None = None,
    suffix: str | None = None,
) -> DataFrame:
    """The collection ``name``, stored as ``<directory>/<name>.<fmt>`` (or with another ``suffix``, ``""`` for none).

    With ``directory=None`` the format is an installed connector (a document store, a database) that finds the
    collection through ``options`` alone.
    """
    reader = spark.read.format(fmt).options(**(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    if directory is None:
        return reader.load()
    ending = f".{fmt}" if suffix is None else suffix
    return reader.load(f"{directory.rstrip('/')}/{name}{ending}")


def stats_table(resolution: str) -> str:
    """Table name of a spatial level, e.g. ``County`` -> ``county_stats``."""
    level = resolution.lower()
    if level not in RESOLUTIONS:
        raise ValueError(f"unknown resolution {resolution!r}, expected one of {RESOLUTIONS}")
    return f"{level}_stats"


def load_stats(
    spark: SparkSession, directory: str | None, resolution: str, table: str | None = None, **load
) -> DataFrame:
    """The statistics table of a resolution; an explicit ``table`` wins."""
    return load_table(spark, directory, table or stats_table(resolution), **load)


def load_clusters(spark: SparkSession, path: str, key: str = "gis_join") -> DataFrame:
    """Cluster assignments ``(cluster_id, <key>, is_center)`` from a CSV file with a header line."""
    return spark.read.schema(CLUSTER_SCHEMA).csv(path, header=True).withColumnRenamed("gis_join", key)


def to_json_column(*cols: str) -> Column:
    return F.to_json(F.struct(*(cols or ("*",))), {"ignoreNullFields": "false"})


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON document per row in column ``json``; null fields are written out, not left away."""
    return df.select(to_json_column().alias("json"))


def from_json_rows(df: DataFrame, schema: StructType | str, json: str = "json", broken: str | None = None) -> DataFrame:
    """The rows that the documents in column ``json`` stand for; fields that a document lacks, and documents that are none, are null.

    With ``broken``, a last column of this name has the text of a document that is none or doesn't fit the schema, else null; null and empty
    texts are rows of nulls that are not broken.
    """
    options = {}
    if broken is not None:
        fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if broken in fields.names:
            raise ValueError(f"{broken!r} is a field of the schema")
        schema = StructType([*fields, StructField(broken, StringType())])
        options["columnNameOfCorruptRecord"] = broken
    return df.select(F.from_json(F.col(f"`{json}`"), schema, options).alias("_row")).select("_row.*")
