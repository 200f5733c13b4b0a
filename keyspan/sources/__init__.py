"""Tables, cluster assignments, JSON text and saved models."""

from keyspan.sources.layout import bounds_from_footers, by_key, counts_from_footers
from keyspan.sources.models import load_models, save_models
from keyspan.sources.storage import shared_dir, staged_by_key, written
from keyspan.sources.tables import load_clusters, load_stats, load_table, to_json_rows

__all__ = [
    "bounds_from_footers",
    "by_key",
    "counts_from_footers",
    "load_clusters",
    "load_models",
    "load_stats",
    "load_table",
    "save_models",
    "shared_dir",
    "staged_by_key",
    "to_json_rows",
    "written",
]
