"""Rounding of scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, places: int = 0) -> Column:
    """x to so many places: the nearest integer to x times a power of ten, halves to the even one.
    The product is a double, so what is a half only as decimal text (2.675) goes where the double lies,
    but for products that round to a half; ``numpy.round`` and DuckDB's ``round_even`` say the same."""
    return F.rint(x * 10.0**places) / 10.0**places
