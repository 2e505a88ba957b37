"""Spark jobs that collect, validate, deduplicate and publish connection profiles."""
