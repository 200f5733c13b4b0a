"""Moving averages over the series of every key.

A series is the rows of one key in the order of a date column, ties broken by a row id. Most keys have short series, and one
shuffle on the key puts each of them, sorted, into a task. A key with more than ``split_rows`` rows would make that task the
bottleneck. The rows of such keys are sorted globally, numbered within their key, and cut into blocks of ``split_rows`` consecutive rows; each
block also gets copies of the few rows before it that its first windows reach back to. No task then holds more than a block
of a series, whatever the distribution of the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keyspan.operators.frames import filter_keys, quoted
from keyspan.operators.positions import numbered
from keyspan.sources.storage import written

SPLIT_ROWS = 1_000_000
# Most entries of one array in a result row; longer series continue in further rows (``part`` 1, 2, ...).
ARRAY_ROWS = 100_000
# Windows of so many rows at most are added up row by row.
FRAME_DAYS = 64


def _series_rows(df: DataFrame, key: str, order: str, feature: str, row_id: str | list[str]) -> DataFrame:
    """The columns of a series under internal names. Rows without key or value (null or NaN) take no part."""
    ids = [row_id] if isinstance(row_id, str) else list(row_id)
    return df.select(
        quoted(key).alias("_key"),
        quoted(order).alias("_date"),
        F.struct(*[quoted(c).alias(f"_{i}") for i, c in enumerate(ids)]).alias("_id"),
        quoted(feature).cast("double").alias("_value"),
    ).where(F.col("_key").isNotNull() & F.col("_value").isNotNull() & ~F.isnan("_value"))


def long_series(df: DataFrame, key: str, split_rows: int) -> DataFrame:
    """Keys with more than ``split_rows`` rows. Reads the key column only, combines before the shuffle."""
    keyed = df.select(quoted(key).alias("_key")).where(F.col("_key").isNotNull())
    counts = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > split_rows).select("_key")


def _first_type(rows: DataFrame) -> StructType:
    return rows.select(F.struct("_date").alias("_first")).schema["_first"].dataType


def _in_blocks(rows: DataFrame, reach: int, size: int) -> DataFrame:
    """Rows in blocks of ``size`` consecutive rows of a key, the last ``reach`` of each copied to the next block."""
    placed = numbered(rows, "_key", ["_date", "_id"], {"_first": F.struct("_date")})
    placed = placed.withColumn("_home", F.floor(F.col("_position") / F.lit(size)).cast("int"))
    near_end = F.col("_position") % F.lit(size) >= F.lit(size - reach)
    blocks = F.when(near_end, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))
    return placed.withColumn("_block", F.explode(blocks)).select(
        "_key", "_date", "_id", "_value", "_first", "_block", (F.col("_block") == F.col("_home")).alias("_own")
    )


def _lay_out(
    df: DataFrame, key: str, order: str, feature: str, row_id: str | list[str], reach: int, split_rows: int | None
) -> tuple[DataFrame, list[str]]:
    """Series rows plus ``_own`` (false for copies), and the columns whose groups hold a series or a piece of one.

    Pieces are numbered by ``_block`` within their key, and ``_first`` holds the first date of a key that has several.
    """
    if split_rows is not None and split_rows < 1:
        raise ValueError("split_rows must be at least 1")
    rows = _series_rows(df, key, order, feature, row_id)
    whole = rows.withColumns(
        {"_first": F.lit(None).cast(_first_type(rows)), "_block": F.lit(0), "_own": F.lit(True)}
    )
    if split_rows is None:
        return whole, ["_key"]
    # Written down, so that it is counted once, and Spark knows its size and broadcasts it only if that is small.
    long_keys = written(long_series(df, key, split_rows))
    if long_keys.isEmpty():
        return whole, ["_key"]
    blocks = _in_blocks(rows.join(long_keys, "_key", "left_semi"), reach, max(split_rows, reach))
    return blocks.unionByName(whole.join(long_keys, "_key", "left_anti")), ["_key", "_block"]


def _check_days(days: int) -> None:
    if days < 1:
        raise ValueError(f"days must be at least 1, not {days}")


def _averaged(laid: DataFrame, groups: list[str], days: int) -> DataFrame:
    """Own rows with ``_avg`` over the last ``days`` rows, null where the series is still shorter.

    A short window is added up for every row. For longer ones the series is cut into runs of ``days`` rows with sums up to every row
    and from every row on: a window is the end of one run and the beginning of the next, whatever ``days`` is.
    """
    w = Window.partitionBy(*groups).orderBy("_date", "_id")
    if days <= FRAME_DAYS:
        average = F.avg("_value").over(w.rowsBetween(1 - days, 0))
        return laid.withColumns({"_full": F.row_number().over(w) >= days, "_avg": average}).where("_own")
    placed = laid.withColumn("_row", F.row_number().over(w))
    placed = placed.withColumn("_run", F.floor((F.col("_row") - 1) / F.lit(days)).cast("int"))
    run = Window.partitionBy(*groups, "_run")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    # Backwards first: the order of the forward sums is that of the last step as well.
    placed = placed.withColumn("_rest", F.sum("_value").over(run.orderBy(F.desc("_row")).rowsBetween(*so_far)))
    placed = placed.withColumn("_sum", F.sum("_value").over(run.orderBy("_row").rowsBetween(*so_far)))
    before = F.lag("_rest", days - 1).over(Window.partitionBy(*groups).orderBy("_run", "_row"))
    total = F.when(F.col("_row") % F.lit(days) == 0, F.col("_sum")).otherwise(F.col("_sum") + before)
    return placed.withColumns({"_full": F.col("_row") >= days, "_avg": total / F.lit(days)}).drop("_row", "_run", "_rest", "_sum").where("_own")


def _id_columns(row_id: str | list[str], taken: tuple[str, ...]) -> list[Column]:
    ids = [row_id] if isinstance(row_id, str) else list(row_id)
    return [F.col("_id")[f"_{i}"].alias(c) for i, c in enumerate(ids) if c not in taken]


def moving_average(
    df: DataFrame,
    key: str,
    order: str,
    feature: str,
    days: int,
    row_id: str | list[str],
    split_rows: int | None = SPLIT_ROWS,
) -> DataFrame:
    """Average of every ``days`` consecutive rows of a key, dated with the last of them: ``(key, order, row_id, avg)``.

    A key with n rows gives n - days + 1 averages, none if n < days. ``row_id`` makes a row unique within its key and date.
    ``split_rows=None`` says that no series is long (one row per day, say) and saves looking.
    """
    _check_days(days)
    laid, groups = _lay_out(df, key, order, feature, row_id, days - 1, split_rows)
    return (
        _averaged(laid, groups, days)
        .where("_full")
        .select(
            F.col("_key").alias(key),
            F.col("_date").alias(order),
            *_id_columns(row_id, (key, order)),
            F.col("_avg").alias("avg"),
        )
    )


# A piece's part of its key's answer, and the first date of the key.
def _part() -> Column:
    return F.first("_block").alias("part")


def _start_date() -> Column:
    return F.coalesce(F.first("_first"), F.min(F.struct("_date")))["_date"].alias("start_date")


def series(
    df: DataFrame,
    key: str,
    order: str,
    feature: str,
    row_id: str | list[str],
    array_rows: int = ARRAY_ROWS,
) -> DataFrame:
    """The ordered series of every key as arrays: ``(key, part, series[value, date])``.

    ``part`` counts from 0 within the key and is always there: every part but a key's last has ``array_rows`` entries, whatever
    other keys the table has.
    """
    laid, groups = _lay_out(df, key, order, feature, row_id, 0, array_rows)
    pieces = laid.groupBy(*groups).agg(
        _part(), F.array_sort(F.collect_list(F.struct("_date", "_id", "_value"))).alias("_rows")
    )
    values = F.transform(
        "_rows", lambda r: F.struct(r["_value"].alias("value"), r["_date"].alias("date"))
    )
    return pieces.select(F.col("_key").alias(key), "part", values.alias("series"))


def moving_average_arrays(
    df: DataFrame,
    key: str,
    order: str,
    feature: str,
    days: int,
    row_id: str | list[str],
    array_rows: int = ARRAY_ROWS,
) -> DataFrame:
    """Moving averages as one answer per key: ``(key, part, moving_averages[avg, date], num_days, start_date)``.

    ``start_date`` is the first date of the series; a key with too few rows has an empty array. A series longer than
    ``array_rows`` continues in further parts, each with at most that many averages.
    """
    _check_days(days)
    laid, groups = _lay_out(df, key, order, feature, row_id, days - 1, array_rows)
    point = F.when(F.col("_full"), F.struct("_date", "_id", "_avg"))
    pieces = _averaged(laid, groups, days).groupBy(*groups).agg(
        _part(),
        _start_date(),
        F.array_sort(F.collect_list(point)).alias("_points"),
    )
    averages = F.transform("_points", lambda p: F.struct(p["_avg"].alias("avg"), p["_date"].alias("date")))
    return pieces.select(
        F.col("_key").alias(key),
        "part",
        averages.alias("moving_averages"),
        F.lit(days).alias("num_days"),
        "start_date",
    )


def moving_average_request(
    df: DataFrame,
    requested: list | DataFrame,
    key: str,
    order: str,
    feature: str,
    days: int,
    row_id: str | list[str],
    array_rows: int = ARRAY_ROWS,
) -> DataFrame:
    """One answer per requested key, repeated keys answered again: ``(pos, key, part, moving_averages, num_days, start_date)``.

    ``requested`` is a list of keys or a DataFrame ``(pos, key)``. Unknown keys have an empty array and no start date.
    ``pos, part`` is the order of the answers.
    """
    if not isinstance(requested, DataFrame):
        kind = df.schema[key].dataType.simpleString()
        requested = df.sparkSession.createDataFrame(list(enumerate(requested)), f"pos bigint, `{key}` {kind}")
    wanted = requested.select("pos", key)
    rows = filter_keys(df, key, wanted)
    answers = moving_average_arrays(rows, key, order, feature, days, row_id, array_rows)
    types = answers.schema
    return wanted.join(answers, key, "left").select(
        "pos",
        quoted(key),
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("moving_averages", F.array().cast(types["moving_averages"].dataType)).alias("moving_averages"),
        F.lit(days).alias("num_days"),
        "start_date",
    )


def moving_average_from_arrays(
    df: DataFrame,
    key: str,
    order: str,
    feature: str,
    days: int,
    row_id: str | list[str],
    array_rows: int = ARRAY_ROWS,
) -> DataFrame:
    """``moving_average`` computed with array functions: slices of an ordered array, one per window.

    Same rows as ``moving_average``, which is the faster form; the two check each other.
    """
    _check_days(days)
    laid, groups = _lay_out(df, key, order, feature, row_id, days - 1, array_rows)
    arrays = laid.groupBy(*groups).agg(
        F.array_sort(F.collect_list(F.struct("_date", "_id", "_value", "_own"))).alias("_rows")
    )

    def window(i: Column) -> Column:
        total = F.aggregate(F.slice("_rows", i, days), F.lit(0.0), lambda acc, r: acc + r["_value"])
        last = F.element_at("_rows", i + F.lit(days - 1))
        return F.struct(
            last["_date"].alias("_date"),
            last["_id"].alias("_id"),
            last["_own"].alias("_own"),
            (total / F.lit(days)).alias("_avg"),
        )

    starts = F.sequence(F.lit(1), F.size("_rows") - F.lit(days - 1))
    windows = F.when(F.size("_rows") >= F.lit(days), F.transform(starts, window))
    return (
        arrays.select("_key", F.inline(windows))
        .where("_own")
        .select(
            F.col("_key").alias(key),
            F.col("_date").alias(order),
            *_id_columns(row_id, (key, order)),
            F.col("_avg").alias("avg"),
        )
    )
