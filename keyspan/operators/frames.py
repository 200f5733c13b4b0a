"""Projections, predicates and ad hoc aggregation steps."""

from __future__ import annotations

import datetime as dt
import operator
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]

# Longer key lists become a join instead of one long IN expression. Either way a value is cast to the column's type.
IN_LIST_KEYS = 500

COMPARISONS = {
    "=": operator.eq,
    ">": operator.gt,
    "<": operator.lt,
    ">=": operator.ge,
    "<=": operator.le,
}


def quoted(name: str) -> Column:
    """A column by its literal name, whatever characters or leading digits it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def select_columns(
    df: DataFrame, key: str, features: list[str], label: str | None = None, row_id: str | list[str] | None = None
) -> DataFrame:
    """Narrow to id, key, features and label, each once; the label is renamed to ``label``."""
    ids = [row_id] if isinstance(row_id, str) else list(row_id or [])
    names = list(dict.fromkeys([*ids, key, *features]))
    cols = [quoted(c) for c in names]
    if label is not None:
        cols.append(quoted(label).alias("label"))
    return df.select(*cols)


def filter_key(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(quoted(key) == F.lit(value))


def filter_keys(df: DataFrame, key: str, values: Iterable | DataFrame) -> DataFrame:
    """Rows whose key is in ``values``: a list, or a DataFrame with a column named like the key."""
    if isinstance(values, DataFrame):
        return df.join(values.select(quoted(key)), key, "left_semi")
    wanted = list(dict.fromkeys(v for v in values if v is not None))
    kind = df.schema[key].dataType
    if len(wanted) <= IN_LIST_KEYS:
        return df.where(quoted(key).isin([F.lit(v).cast(kind) for v in wanted]))
    by_type: dict[type, list] = {}
    for value in wanted:
        by_type.setdefault(type(value), []).append((value,))
    listed = [df.sparkSession.createDataFrame(rows, ["_value"]).select(F.col("_value").cast(kind).alias(key)) for rows in by_type.values()]
    return df.join(reduce(DataFrame.unionAll, listed), key, "left_semi")


def _instant(value: str | dt.date | dt.datetime) -> dt.datetime:
    """Midnight for plain dates; texts may carry milliseconds and an offset (``2020-01-31 00:00:00.000 +0000``)."""
    if isinstance(value, dt.datetime):
        moment = value
    elif isinstance(value, dt.date):
        moment = dt.datetime.combine(value, dt.time())
    else:
        text = value.strip()
        for pattern in ("%Y-%m-%d %H:%M:%S.%f %z", "%Y-%m-%d %H:%M:%S %z"):
            try:
                moment = dt.datetime.strptime(text, pattern)
                break
            except ValueError:
                continue
        else:
            moment = dt.datetime.fromisoformat(text)
    if moment.tzinfo is not None:
        moment = moment.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return moment


def filter_dates(df: DataFrame, date_col: str, start, end) -> DataFrame:
    """``start <= date <= end``, compared as calendar dates at midnight.

    The time of day of the bounds is dropped, so the end bound is the *midnight beginning* the end day: a timestamp later
    on that day is outside.
    """
    lo, hi = _instant(start).date(), _instant(end).date()
    kind = df.schema[date_col].dataType.simpleString()
    if kind == "string":
        kind = "timestamp"
        column = F.to_timestamp(quoted(date_col))
    else:
        column = quoted(date_col)
    bounds = [F.lit(d.isoformat()).cast(kind) for d in (lo, hi)]
    return df.where(column.between(*bounds))


def drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows with a null (or a NaN) in any of ``cols``. Written as conditions that the scan can use."""
    if not cols:
        return df
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    present = []
    for c in cols:
        present.append(quoted(c).isNotNull())
        if kinds[c] in ("float", "double"):
            present.append(~F.isnan(quoted(c)))
    return df.where(reduce(operator.and_, present))


def compare(col: str, op: str, value) -> Column:
    """A comparison given as data: ``compare("cases", ">=", 10)``."""
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison {op!r}, expected one of {tuple(COMPARISONS)}")
    other = value if isinstance(value, Column) else F.lit(value)
    return COMPARISONS[op](quoted(col), other)


def find(df: DataFrame, *conditions: Column | tuple) -> DataFrame:
    """Rows meeting all conditions; a tuple ``(col, op, value)`` stands for ``compare(col, op, value)``."""
    columns = [compare(*c) if isinstance(c, tuple) else c for c in conditions]
    return df.where(reduce(operator.and_, columns)) if columns else df


# Steps of an ad hoc aggregation. Any other DataFrame -> DataFrame function is a step as well.


def match(condition: Column) -> Step:
    return lambda df: df.where(condition)


def add_fields(**exprs: Column) -> Step:
    return lambda df: df.withColumns(exprs)


def project(*cols: str | Column) -> Step:
    return lambda df: df.select(*cols)


def group(keys: str | list[str], **aggs: Column) -> Step:
    names = [keys] if isinstance(keys, str) else list(keys)
    return lambda df: df.groupBy(*names).agg(*[agg.alias(name) for name, agg in aggs.items()])


def sort(*cols: str | Column) -> Step:
    return lambda df: df.orderBy(*cols)


def limit(n: int) -> Step:
    return lambda df: df.limit(n)


def aggregate(df: DataFrame, steps: list[Step]) -> DataFrame:
    """Run the steps one after the other; Catalyst sees one plan."""
    return reduce(lambda frame, step: frame.transform(step), steps, df)
