"""Calendar features: harmonics, weekday flags, benefit days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.functions.dates import iso_weekday
from tillweave.functions.maths import harmonic_angle
from tillweave.functions.text import strip_prefix
from tillweave.operators.mixture import mixture_memberships
from tillweave.operators.relational import select_except
from tillweave.operators.reshape import unpivot_columns
from tillweave.operators.windows import day_trend
from tillweave.schemas import CALENDAR_EVENT_COLUMNS, CALENDAR_SNAP_COLUMNS, WEEKDAYS

# Periods in days, number of harmonics, mixture sizes.
YEAR_DAYS = 365.25
MONTH_DAYS = 30.5
HARMONICS = 3
WEEKDAY_COMPONENTS = 3
TREND_COMPONENTS = 12


def _waves(position: Column, period: float, prefix: str) -> dict[str, Column]:
    waves = {}
    for wave, function in (("sin", F.sin), ("cos", F.cos)):
        for k in range(1, HARMONICS + 1):
            waves[f"{prefix}{wave}_{k}"] = function(harmonic_angle(position, period, k))
    return waves


def calendar_fourier(calendar: DataFrame) -> DataFrame:
    """Day of month and year, their sines and cosines, packed as one struct."""
    day = F.col("date")
    plain = select_except(calendar, [*CALENDAR_EVENT_COLUMNS, *CALENDAR_SNAP_COLUMNS])
    year_position = F.dayofyear(day).cast("double") % F.lit(YEAR_DAYS)
    waves = {**_waves(year_position, YEAR_DAYS, ""), **_waves(F.dayofmonth(day), MONTH_DAYS, "month_")}
    return (
        plain.withColumns({"day_of_month": F.dayofmonth(day), "day_of_year": F.dayofyear(day)})
        .withColumns(waves)
        .withColumn("year_month_trigonometric", F.struct(*waves))
    )


def weekday_flags(calendar: DataFrame, source: str = "weekday") -> DataFrame:
    """Seven 0/1 columns from the weekday name, packed as ``weekday_bool``."""
    name = F.lower(F.col(source))
    flags = {d: F.when(name == d, 1).otherwise(0) for d in WEEKDAYS}
    return calendar.withColumns(flags).withColumn("weekday_bool", F.struct(*WEEKDAYS))


def weekday_one_hot(dates: DataFrame, date_col: str = "date") -> DataFrame:
    """Seven 0/1 columns from the date itself."""
    number = iso_weekday(F.col(date_col))
    return dates.withColumns({d: (number == i).cast("int") for i, d in enumerate(WEEKDAYS, 1)})


def calendar_features(calendar: DataFrame) -> DataFrame:
    """All calendar features, the mixture memberships of weekday and trend included."""
    return (
        calendar_fourier(calendar)
        .transform(day_trend)
        .transform(mixture_memberships, "wday", WEEKDAY_COMPONENTS)
        .transform(mixture_memberships, "trend", TREND_COMPONENTS)
        .transform(weekday_flags)
    )


def snap_long(calendar: DataFrame) -> DataFrame:
    """(date, state, snap_bool), one row per date and state."""
    return unpivot_columns(
        calendar, ["date"], CALENDAR_SNAP_COLUMNS, "state", "snap_bool"
    ).withColumn("state", strip_prefix(F.col("state"), "snap_"))


def fourier_terms(df: DataFrame, position: Column, terms: Sequence[tuple[float, int]]) -> DataFrame:
    """Columns ``sin_<period>_<k>`` and ``cos_<period>_<k>`` for each (period, K)."""
    waves = {}
    for period, top in terms:
        for k in range(1, top + 1):
            angle = harmonic_angle(position, period, k)
            waves[f"sin_{period}_{k}"] = F.sin(angle)
            waves[f"cos_{period}_{k}"] = F.cos(angle)
    return df.withColumns(waves)


def calendar_effects(df: DataFrame, date_col: str = "date") -> DataFrame:
    """ISO weekday number of each row."""
    return df.withColumn("weekday", iso_weekday(F.col(date_col)))
