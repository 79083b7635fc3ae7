"""Event features from a calendar with two event column pairs per date.

The event names and types are arguments: they become columns, and a fixed list
gives a fixed schema without a job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.functions.dates import days_around
from tillweave.functions.text import join_text
from tillweave.operators.mixture import mixture_memberships
from tillweave.operators.relational import quoted
from tillweave.operators.summaries import event_days

# Days around an event, days after it, and the horizons in days.
WINDOW_DAYS = 4
POST_DAYS = 7
HORIZONS = (1, 3, 6, 13, 20)
WINDOW_COMPONENTS = 3


def _is_event(name: str) -> Column:
    hit = (F.col("event_name_1") == name) | (F.col("event_name_2") == name)
    return F.coalesce(hit, F.lit(False))


def event_flags(calendar: DataFrame, names: Sequence[str]) -> DataFrame:
    """(date, holiday_bool): a struct with one 0/1 field per event name.

    Both events of a date sit in its own row, so no pivot and no shuffle.
    """
    flags = [F.when(_is_event(n), 1).otherwise(0).alias(n) for n in names]
    return calendar.select("date", F.struct(*flags).alias("holiday_bool"))


def event_matrix(events: DataFrame, names: Sequence[str], types: Sequence[str]) -> DataFrame:
    """0/1 per event type and event name for the dates that have an event."""

    def flag(column: str, value: str) -> Column:
        return F.max(F.when(F.col(column) == value, 1).otherwise(0)).alias(value)

    return events.groupBy("date").agg(
        *[flag("event_type", t) for t in types], *[flag("event_name", n) for n in names]
    )


def event_positions(calendar: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """(event, event_date, date, spline): the days around each occurrence.

    ``spline`` is the 0-based position in the window; events are lower case.
    """
    return (
        event_days(calendar)
        .select(F.lower("event_name").alias("event"), F.col("date").alias("event_date"))
        .select("event", "event_date", F.explode(days_around(F.col("event_date"), days, days)).alias("date"))
        .withColumn("spline", F.datediff("date", "event_date") + F.lit(days))
    )


def event_window_memberships(
    calendar: DataFrame, names: Sequence[str], components: int = WINDOW_COMPONENTS
) -> DataFrame:
    """(date, holiday_pre_post_guassian_splines): per event and mixture component
    the membership of each date near the event, 0 elsewhere.

    Where two windows of one event meet, the larger membership counts.
    """
    near = mixture_memberships(event_positions(calendar), "spline", components)
    cells = [
        F.max(F.when(F.col("event") == n.lower(), F.col(f"spline_guassian_splines.spline_{k}"))).alias(
            f"{n.lower()}_spline_{k}"
        )
        for n in names
        for k in range(1, components + 1)
    ]
    labels = [f"{n.lower()}_spline_{k}" for n in names for k in range(1, components + 1)]
    wide = near.groupBy("date").agg(*cells)
    return (
        calendar.select("date")
        .join(wide, "date", "left")
        .select(
            "date",
            F.struct(*[F.coalesce(F.col(quoted(c)), F.lit(0.0)).alias(c) for c in labels]).alias(
                "holiday_pre_post_guassian_splines"
            ),
        )
    )


def event_label(row_type: str, name: str) -> str:
    """Feature name of an event, without the day number."""
    return f"EVENT_{row_type.upper()}_{name.upper()}"


def post_event_days(calendar: DataFrame, days: int = POST_DAYS) -> DataFrame:
    """(date, event, range, feature): the days after each occurrence."""
    label = join_text("EVENT_", F.upper("event_type"), "_", F.upper("event_name"))
    after = F.explode(days_around(F.col("date"), -1, days)).alias("range")
    return (
        event_days(calendar)
        .select("date", label.alias("event"))
        .select("date", "event", after)
        .withColumn("feature", join_text(F.col("event"), "_", F.datediff("range", "date").cast("string")))
    )


def event_post_effects(
    calendar: DataFrame, labels: Sequence[str], days: int = POST_DAYS
) -> DataFrame:
    """Counts per (range, event), one column per event and day after it."""
    features = [f"{label}_{n}" for label in labels for n in range(1, days + 1)]
    counts = [F.count_if(F.col("feature") == f).alias(f) for f in features]
    return post_event_days(calendar, days).groupBy("range", "event").agg(*counts)


def event_lead_lag(
    calendar: DataFrame,
    names: Sequence[str],
    types: Sequence[str] = (),
    horizons: Sequence[int] = HORIZONS,
) -> DataFrame:
    """Per event column a struct of 0/1 fields ``<event>_<h>d`` and ``<event>_-<h>d``.

    ``_6d`` is 1 from the event day to 6 days after it, ``_-6d`` from 6 days
    before it to the event day. Each event day is spread over the widest
    horizon once; per date only the distance to the last and the next event is
    kept, and every horizon follows from those two numbers.
    """
    reach = max(horizons)
    spread = event_days(calendar).select(
        F.col("date").alias("event_date"),
        "event_name",
        "event_type",
        F.explode(days_around(F.col("date"), reach, reach)).alias("date"),
    )
    offset = F.datediff("date", "event_date")
    targets = [(t, "event_type") for t in types] + [(n, "event_name") for n in names]
    distances = []
    for i, (value, column) in enumerate(targets):
        mine = F.col(column) == value
        distances.append(F.min(F.when(mine & (offset >= 0), offset)).alias(f"_since_{i}"))
        distances.append(F.min(F.when(mine & (offset <= 0), -offset)).alias(f"_until_{i}"))
    near = spread.groupBy("date").agg(*distances)

    def within(column: str, days: int, name: str) -> Column:
        return F.when(F.col(column) <= days, 1).otherwise(0).alias(name)

    structs = [
        F.struct(
            *[within(f"_since_{i}", h, f"{value}_{h}d") for h in horizons],
            *[within(f"_until_{i}", h, f"{value}_-{h}d") for h in horizons],
        ).alias(value)
        for i, (value, _) in enumerate(targets)
    ]
    return calendar.select("date").join(near, "date", "left").select("date", *structs)
