"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_weekday(day: Column) -> Column:
    """Monday = 1 .. Sunday = 7."""
    return F.weekday(day) + F.lit(1)


def date_span(start: Column, end: Column) -> Column:
    """All dates from start to end; empty when end lies before start.

    ``sequence`` alone would count backwards in that case. A null bound gives
    a null list.
    """
    return F.when(start > end, F.array().cast("array<date>")).otherwise(
        F.sequence(start, end, F.expr("interval 1 day"))
    )


def days_around(day: Column, before: int, after: int) -> Column:
    """The dates from ``before`` days earlier to ``after`` days later."""
    return date_span(F.date_add(day, -before), F.date_add(day, after))
