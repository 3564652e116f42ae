"""Incremental versions of the aggregations."""
