"""Operators over keyed tables. Each takes and returns DataFrames."""

from keyspan.operators.documents import run_documents
from keyspan.operators.frames import (
    add_fields,
    aggregate,
    compare,
    drop_incomplete,
    filter_dates,
    filter_key,
    filter_keys,
    find,
    group,
    limit,
    match,
    project,
    select_columns,
    sort,
)
from keyspan.operators.joins import Query, compound, compound_join, dedupe_last, with_parent
from keyspan.operators.summaries import (
    cluster_groups,
    cluster_members,
    count_tables,
    key_summary,
    mean_by_key,
    mean_over_dates,
)
from keyspan.operators.windows import (
    moving_average,
    moving_average_arrays,
    moving_average_from_arrays,
    moving_average_request,
    series,
)

__all__ = [
    "Query",
    "add_fields",
    "aggregate",
    "cluster_groups",
    "cluster_members",
    "compare",
    "compound",
    "compound_join",
    "count_tables",
    "dedupe_last",
    "drop_incomplete",
    "filter_dates",
    "filter_key",
    "filter_keys",
    "find",
    "group",
    "key_summary",
    "limit",
    "match",
    "mean_by_key",
    "mean_over_dates",
    "moving_average",
    "moving_average_arrays",
    "moving_average_from_arrays",
    "moving_average_request",
    "project",
    "run_documents",
    "select_columns",
    "series",
    "sort",
    "with_parent",
]
