"""Keyed analytics on Spark: series, joins, summaries and models for tables whose rows belong to a key."""
