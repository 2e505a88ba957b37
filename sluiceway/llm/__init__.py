"""Operators for large text corpora: deduplication, tokenizing, scoring, search."""
