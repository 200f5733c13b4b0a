"""Aggregation stages sent as JSON documents, as DataFrame operations (D1).

Only the stages and expressions named in ``STAGES`` and ``EXPRESSIONS``; any other raises ``ValueError`` with its name. A ``$sort`` orders
what a later ``$group`` pushes; rows themselves are sorted only where a ``$limit`` or the end follows. What ``$push`` gathers is an array
per group in one row: for series longer than a row should be, see ``moving_average_arrays``, which continues them in parts.

Rows that tie in the order of a ``$sort`` are pushed in the order of their values. ``$avg`` and the like leave out nulls; a field that is not there raises
Spark's error.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.operators.frames import compare, quoted

Scope = dict[str, Column]
# Comparison documents of ``$match``.
COMPARISONS = {"$eq": "==", "$ne": "!=", "$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<="}


def _path(name: str) -> Column:
    return F.col(".".join(f"`{part}`" for part in name.split(".")))


def expression(document, scope: Scope | None = None) -> Column:
    """A column from an expression document: a path, a variable, an operator, a document of expressions, or a value."""
    scope = scope or {}
    if isinstance(document, str) and document.startswith("$$"):
        name, *rest = document[2:].split(".")
        if name not in scope:
            raise ValueError(f"unknown variable {document!r}")
        return reduce(lambda column, part: column[part], rest, scope[name])
    if isinstance(document, str) and document.startswith("$"):
        return _path(document[1:])
    if isinstance(document, list):
        return F.array(*[expression(d, scope) for d in document])
    if isinstance(document, dict):
        if len(document) == 1 and (name := next(iter(document))).startswith("$"):
            if name not in EXPRESSIONS:
                raise ValueError(f"unknown expression {name!r}")
            return EXPRESSIONS[name](document[name], scope)
        return F.struct(*[expression(d, scope).alias(name) for name, d in document.items()])
    return F.lit(document)


def _values(arguments, scope: Scope) -> list[Column]:
    return [expression(a, scope) for a in (arguments if isinstance(arguments, list) else [arguments])]


def _fold(op) -> Callable:
    return lambda arguments, scope: reduce(op, _values(arguments, scope))


def _element(arguments, scope: Scope) -> Column:
    array, at = _values(arguments, scope)
    return F.get(array, F.when(at < 0, at + F.size(array)).otherwise(at).cast("int"))


def _range(arguments, scope: Scope) -> Column:
    start, end, *step = [c.cast("int") for c in _values(arguments, scope)]
    width = step[0] if step else F.lit(1)
    last = end - F.signum(width).cast("int")
    none = (width == 0) | ((end - start) * width <= 0)
    return F.when(none, F.array().cast("array<int>")).otherwise(F.sequence(start, last, width))


def _slice(arguments, scope: Scope) -> Column:
    array, first, *count = _values(arguments, scope)
    if count:
        return F.slice(array, F.when(first < 0, first).otherwise(first + 1).cast("int"), count[0].cast("int"))
    return F.when(first < 0, F.slice(array, F.greatest(first, -F.size(array)).cast("int"), F.abs(first).cast("int"))).otherwise(
        F.slice(array, F.lit(1), first.cast("int"))
    )


def _map(arguments, scope: Scope) -> Column:
    name = arguments.get("as", "this")
    return F.transform(expression(arguments["input"], scope), lambda item: expression(arguments["in"], {**scope, name: item}))


def _numbers(array: Column) -> Column:
    return F.filter(array, lambda v: v.isNotNull())


def _sum(array: Column) -> Column:
    return F.aggregate(_numbers(array), F.lit(0.0), lambda total, v: total + v)


def _average(array: Column) -> Column:
    n = F.size(_numbers(array))
    return F.when(n > 0, _sum(array) / n)


def _of_array(function) -> Callable:
    return lambda argument, scope: function(expression(argument, scope))


EXPRESSIONS: dict[str, Callable] = {
    "$add": _fold(operator.add),
    "$subtract": _fold(operator.sub),
    "$multiply": _fold(operator.mul),
    "$divide": _fold(lambda a, b: a.cast("double") / F.nullif(b, F.lit(0))),
    "$size": _of_array(F.size),
    "$arrayElemAt": _element,
    "$range": _range,
    "$slice": _slice,
    "$map": _map,
    "$avg": _of_array(_average),
    "$sum": _of_array(_sum),
    "$min": _of_array(F.array_min),
    "$max": _of_array(F.array_max),
}

# Accumulators of a group whose order doesn't matter.
ACCUMULATORS = {"$sum": F.sum, "$avg": F.avg, "$min": F.min, "$max": F.max}


def _condition(document: dict) -> Column:
    parts = []
    for name, wanted in document.items():
        if name.startswith("$"):
            raise ValueError(f"unknown condition {name!r}")
        tests = wanted if isinstance(wanted, dict) else {"$eq": wanted}
        for test, value in tests.items():
            if test == "$in":
                parts.append(_path(name).isin(value))
            elif test not in COMPARISONS:
                raise ValueError(f"unknown comparison {test!r}")
            elif value is None and test in ("$eq", "$ne"):
                parts.append(_path(name).isNull() if test == "$eq" else _path(name).isNotNull())
            else:
                parts.append(compare(name, COMPARISONS[test], value))
    return reduce(operator.and_, parts, F.lit(True))


def _accumulated(document: dict, order: dict[str, int]) -> Column:
    (name, argument), *more = document.items()
    if more:
        raise ValueError(f"one accumulator per field, not {sorted(document)}")
    if name in ACCUMULATORS:
        return ACCUMULATORS[name](expression(argument))
    if name not in ("$push", "$first", "$last"):
        raise ValueError(f"unknown accumulator {name!r}")
    directions = set(order.values())
    if len(directions) > 1:
        raise ValueError(f"{name} after a $sort in two directions")
    keys = [_path(field).alias(f"_{i}") for i, field in enumerate(order)]
    placed = F.struct(*keys, expression(argument).alias("value"))
    if name == "$push":
        return F.transform(F.sort_array(F.collect_list(placed), asc=directions != {-1}), lambda p: p["value"])
    return (F.min if (name == "$first") == (directions != {-1}) else F.max)(placed)["value"]


def _group(df: DataFrame, document: dict, order: dict[str, int]) -> DataFrame:
    fields = dict(document)
    key = expression(fields.pop("_id")).alias("_id")
    aggregates = [_accumulated(d, order).alias(name) for name, d in fields.items()]
    # A group without accumulators is the distinct keys.
    return df.groupBy(key).agg(*aggregates) if aggregates else df.select(key).distinct()


def _project(df: DataFrame, document: dict) -> DataFrame:
    columns = {"_id": quoted("_id")} if "_id" in df.columns and "_id" not in document else {}
    for name, wanted in document.items():
        if wanted in (0, False):
            if name != "_id":
                raise ValueError("$project names what stays")
        else:
            columns[name] = _path(name) if wanted in (1, True) else expression(wanted)
    return df.select(*[column.alias(name) for name, column in columns.items()])


def _sorted(df: DataFrame, order: dict[str, int]) -> DataFrame:
    # As the store orders them: missing values before all others.
    columns = [_path(f).asc_nulls_first() if d > 0 else _path(f).desc_nulls_last() for f, d in order.items()]
    return df.orderBy(*columns) if columns else df


STAGES = ("$match", "$sort", "$group", "$addFields", "$project", "$limit")


def run_documents(df: DataFrame, stages: str | list[dict]) -> DataFrame:
    """The rows that the stages, a JSON array or its parsed form, make of ``df``."""
    order: dict[str, int] = {}
    for stage in json.loads(stages) if isinstance(stages, str) else stages:
        if len(stage) != 1 or (name := next(iter(stage))) not in STAGES:
            raise ValueError(f"unknown stage {sorted(stage)}")
        body = stage[name]
        if name == "$match":
            df = df.where(_condition(body))
        elif name == "$sort":
            order = dict(body)
        elif name == "$group":
            df, order = _group(df, body, order), {}
        elif name == "$limit":
            df, order = _sorted(df, order).limit(body), order
        else:
            # Later fields may hide what the order is by.
            df, order = (_sorted(df, order), {}) if set(order) & set(body) or name == "$project" else (df, order)
            df = _project(df, body) if name == "$project" else df.withColumns({n: expression(d) for n, d in body.items()})
    return _sorted(df, order)
