"""Scalar expressions with the semantics that the analytics need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Second boundaries crossed from start to end: .9 to 1.1 is 1."""
    at = lambda c: F.unix_seconds(as_column(c).cast("timestamp"))
    return at(end) - at(start)


def ratio(n: Column | str, d: Column | str) -> Column:
    """n / d as double; null where d is 0."""
    return as_column(n).cast("double") / F.nullif(as_column(d).cast("double"), F.lit(0.0))


#: Decimal places that a double is taken to before it is rounded: ties that binary fractions miss are ties again,
#: and go away from zero on either side of it.
EXACT = "decimal(38,12)"


def rounded(x: Column, places: int) -> Column:
    return F.round(x.cast(EXACT), places).cast("double")


def percent(n: Column | str, d: Column | str, places: int = 2) -> Column:
    return rounded(F.lit(100.0) * as_column(n).cast("double") / F.nullif(as_column(d).cast("double"), F.lit(0.0)), places)


def f1(precision: Column, recall: Column, places: int = 4) -> Column:
    """Harmonic mean of two shares; null where either is null or both are 0."""
    return rounded(F.lit(2.0) * precision * recall / F.nullif(precision + recall, F.lit(0.0)), places)


def average(c: Column | str, places: int) -> Column:
    return rounded(F.avg(c), places)
