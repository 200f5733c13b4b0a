"""Trained tree models per key on disk, each with the accuracy it reached beside it."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession

from keyspan.sources.storage import path_exists

MODEL_CLASSES = {"random_forest": RandomForestRegressionModel, "gradient_boost": GBTRegressionModel}


def _path(directory: str, key, ending: str) -> str:
    """A path of its own for every key, also for an empty one and one with slashes."""
    return f"{directory.rstrip('/')}/key-{quote(str(key), safe='')}.{ending}"


def save_models(models: dict, metrics: DataFrame, directory: str, overwrite: bool = True) -> None:
    """Write every model to ``<directory>/key-<key>.model`` and then its row ``(key, rmse, r2)`` to ``key-<key>.accuracy``.

    Models of other keys in the directory keep theirs. A model without accuracy is one whose writing was broken off.
    """
    key_column = metrics.columns[0]
    rows = {r[key_column]: r for r in metrics.toLocalIterator()}
    mode = "overwrite" if overwrite else "errorifexists"
    for key, model in models.items():
        writer = model.write()
        if overwrite:
            writer = writer.overwrite()
        writer.save(_path(directory, key, "model"))
        if key in rows:
            own = metrics.sparkSession.createDataFrame([rows[key]], metrics.schema)
            own.coalesce(1).write.mode(mode).parquet(_path(directory, key, "accuracy"))


def load_models(spark: SparkSession, keys: list, directory: str, kind: str) -> tuple[dict, list]:
    """Saved models of ``keys`` and the list of keys that have none."""
    models, missing = {}, []
    for key in keys:
        path = _path(directory, key, "model")
        if path_exists(spark, path):
            models[key] = MODEL_CLASSES[kind].load(path)
        else:
            missing.append(key)
    return models, missing


def load_targets(spark: SparkSession, directory: str) -> DataFrame:
    """The accuracy rows of all models that ``save_models`` wrote to ``directory``."""
    return spark.read.parquet(f"{directory.rstrip('/')}/key-*.accuracy")
