"""Runs all jobs in dependency order, from external inputs to the design matrix and its back-test.

Each step reads what the step before wrote, so a lost step is repeated from
files and not from the start. A manifest beside each data set names its inputs,
so that a step runs only if one of them changed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillweave.operators.summaries import event_days
from tillweave.plans import calendar_features as calendars
from tillweave.plans import backtest, design, events, interim, raw
from tillweave.sources.zones import (
    inline_table,
    is_bucketed,
    new_stamp,
    read_bucketed,
    read_latest,
    snapshot_stamps,
    write_bucketed,
    write_zone,
    zone_path,
)


@dataclass
class Inputs:
    """External inputs: give the wide file, or the long panel with its dimension."""

    calendar: DataFrame
    prices: DataFrame
    event_names: Sequence[str]
    sales_wide: DataFrame | None = None
    sales_long: DataFrame | None = None
    prodloc: DataFrame | None = None


# Fixed names: data sets in the order they are written, with their zones.
DATA_SETS = [
    ("2.raw", "prodloc_raw"),
    ("2.raw", "sales_raw"),
    ("2.raw", "calendar_raw"),
    ("2.raw", "price_raw"),
    ("3.interim", "prodlocs"),
    ("3.interim", "sales"),
    ("3.interim", "calendar_event_bool_features"),
    ("3.interim", "event_post_effect_features"),
    ("3.interim", "snap_features"),
    ("3.interim", "calender_features"),
    ("3.interim", "calendar_event_gmm_features"),
    ("3.interim", "regressor_table"),
    ("4.processed", "designmatrix"),
]
# Fixed names: what the back-test writes.
BACKTEST_SETS = [
    ("4.processed", "backtest_predictions"),
    ("4.processed", "backtest_coefficients"),
    ("4.processed", "backtest_metrics"),
]


@dataclass(frozen=True)
class Step:
    """One data set: where it goes, the data sets it is made of, and how."""

    zone: str
    name: str
    needs: tuple[str, ...]
    make: Callable[..., DataFrame]
    sort_by: tuple[str, ...] = ()
    #: Key by which it is dealt to buckets, if there are any.
    by: tuple[str, ...] = ()


ZONE_OF = {name: zone for zone, name in DATA_SETS}


def _event_labels(calendar: DataFrame, event_names: Sequence[str]) -> list[str]:
    """Labels of the listed events, at most one per name and type; they become column names."""
    pairs = event_days(calendar).where(F.col("event_name").isin(list(event_names))).select("event_type", "event_name").distinct()
    return sorted(events.event_label(r["event_type"], r["event_name"]) for r in pairs.collect())


def raw_steps(inputs: Inputs) -> list[Step]:
    """Raw zone: product-locations, long sales, calendar, daily prices."""
    if inputs.sales_wide is not None:
        prodloc = lambda: raw.prodloc_raw(inputs.sales_wide)
        sales = lambda: raw.sales_raw(inputs.sales_wide, inputs.calendar)
    elif inputs.sales_long is not None and inputs.prodloc is not None:
        prodloc, sales = lambda: inputs.prodloc, lambda: inputs.sales_long
    else:
        raise ValueError("give sales_wide, or sales_long and prodloc")
    return [
        Step("2.raw", "prodloc_raw", (), prodloc, by=("id",)),
        Step("2.raw", "sales_raw", (), sales, ("id", "date"), ("id",)),
        Step("2.raw", "calendar_raw", (), lambda: raw.calendar_raw(inputs.calendar)),
        Step("2.raw", "price_raw", ("prodloc_raw", "calendar_raw"), lambda known, days: raw.price_daily(inputs.prices, known, days)),
    ]


def interim_steps(event_names: Sequence[str], threshold: float) -> list[Step]:
    """Interim zone, from the newest raw snapshots."""
    names = list(event_names)
    calendar = ("calendar_raw",)
    return [
        Step("3.interim", "prodlocs", ("prodloc_raw", "sales_raw"), interim.prodloc_lifecycle, by=("id",)),
        Step("3.interim", "sales", ("sales_raw",), lambda sales: interim.sales_interim(sales, threshold), ("id", "date"), ("id",)),
        Step("3.interim", "calendar_event_bool_features", calendar, lambda c: events.event_flags(c, names)),
        Step("3.interim", "event_post_effect_features", calendar, lambda c: events.event_post_effects(c, _event_labels(c, names))),
        Step("3.interim", "snap_features", calendar, calendars.snap_long),
        Step("3.interim", "calender_features", calendar, calendars.calendar_features),
        Step("3.interim", "calendar_event_gmm_features", calendar, lambda c: events.event_window_memberships(c, names)),
    ]


def design_steps() -> list[Step]:
    """Regressor table and design matrix, the latter sorted by id and date inside each file.

    The regressor table is a data set: with its true size known, the join to the facts is a broadcast from the start
    and the panel is shuffled once.
    """
    features = ("snap_features", "calender_features", "calendar_event_bool_features", "calendar_event_gmm_features")
    return [
        Step("3.interim", "regressor_table", features, design.regressor_table),
        Step("4.processed", "designmatrix", ("sales", "prodlocs", "regressor_table"), design.design_matrix, ("id", "date"), ("id",)),
    ]


def _newest_stamp(spark: SparkSession, root: str, zone: str, name: str) -> str | None:
    try:
        stamps = snapshot_stamps(spark, zone_path(root, zone, name))
    except AnalysisException:  # nothing was ever written there
        return None
    return stamps[-1] if stamps else None


def _newest(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The newest snapshot of a data set, in its buckets if it has any."""
    zone = ZONE_OF[name]
    if is_bucketed(spark, root, zone, name):
        return read_bucketed(spark, root, zone, name)
    return read_latest(spark, root, zone, name)


def run_steps(
    spark: SparkSession,
    root: str,
    steps: Sequence[Step],
    stamp: str,
    settings: str = "",
    version: str | None = None,
    buckets: int | None = None,
) -> list[tuple[str, str]]:
    """Run the steps whose inputs have changed and return the (zone, data set) pairs written.

    Beside each data set lies a manifest of the snapshots and settings that it was made from, written after it. A step
    is left out if its newest manifest names its newest snapshot and today's inputs. So a second run writes nothing, and
    a run that failed goes on with the step that was lost. Steps without inputs in the zones depend on ``version``, the
    caller's name for the external files; without one they always run.

    With ``buckets`` the data sets by id are written dealt by it, so that the steps that read them shuffle no panel.
    """
    written = []
    for step in steps:
        used = [f"{n}={_newest_stamp(spark, root, ZONE_OF[n], n)}" for n in step.needs]
        made_from = ";".join([*used, f"settings={settings}", f"version={version}"])
        newest = _newest_stamp(spark, root, step.zone, step.name)
        known = version is not None or step.zone != "2.raw"
        if known and newest is not None and _newest_stamp(spark, root, step.zone, f"{step.name}_manifest") == newest:
            if read_latest(spark, root, step.zone, f"{step.name}_manifest").first()["made_from"] == made_from:
                continue
        made = step.make(*[_newest(spark, root, n) for n in step.needs])
        order = list(step.sort_by) or None
        if buckets and step.by:
            write_bucketed(made, list(step.by), buckets, root, step.zone, step.name, stamp=stamp, sort_by=order)
        else:
            write_zone(made, root, step.zone, step.name, stamp=stamp, sort_by=order)
        manifest = inline_table(spark, [(made_from,)], "made_from string")
        write_zone(manifest, root, step.zone, f"{step.name}_manifest", stamp=stamp)
        written.append((step.zone, step.name))
    return written


def build_backtest(
    spark: SparkSession,
    root: str,
    splits: Callable[[DataFrame], backtest.Splits] | None = None,
    alpha: float = backtest.LASSO_ALPHA,
    stamp: str | None = None,
) -> list[tuple[str, str]]:
    """Back-test of the newest design matrix: predictions of all splits, coefficients, error metrics.

    ``splits`` makes the splits from the store panel; the default trains three years before the first test date and
    goes on to the last date. Each data set is written once and the metrics are taken from the written predictions.
    """
    stamp = stamp or new_stamp()
    matrix = read_latest(spark, root, "4.processed", "designmatrix")
    regressors = read_latest(spark, root, "3.interim", "regressor_table")
    panel = design.store_panel_from_matrix(matrix, regressors)
    rows, coefficients = backtest.backtest_panel(panel, (splits or backtest.splits_to_the_end)(panel), alpha)
    columns = backtest.BACKTEST_COLUMNS
    write_zone(rows.select(*columns), root, "4.processed", "backtest_predictions", stamp=stamp, sort_by=["set_index", "store_id", "date"])
    write_zone(coefficients, root, "4.processed", "backtest_coefficients", stamp=stamp)
    written = read_latest(spark, root, "4.processed", "backtest_predictions", stamp=stamp)
    write_zone(backtest.error_metrics(written, ["set_index", "set_type"]), root, "4.processed", "backtest_metrics", stamp=stamp)
    return list(BACKTEST_SETS)


def build_all(
    spark: SparkSession,
    root: str,
    inputs: Inputs,
    threshold: float = interim.LIVE_THRESHOLD,
    version: str | None = None,
    buckets: int | None = None,
) -> list[tuple[str, str]]:
    """Bring every data set up to date and return the (zone, data set) pairs written.

    ``version`` names the external inputs; with the same one again only what is missing or older than its inputs is made.
    ``buckets``, sized so that one holds a few hundred MB of the panel, deals all data sets by id in the same way.
    """
    stamp, names = new_stamp(), sorted(inputs.event_names)
    settings = f"events {names} threshold {threshold}"
    written = run_steps(spark, root, raw_steps(inputs), stamp, version=version, buckets=buckets)
    written += run_steps(spark, root, interim_steps(inputs.event_names, threshold), stamp, settings, buckets=buckets)
    return written + run_steps(spark, root, design_steps(), stamp, buckets=buckets)


def row_counts(spark: SparkSession, root: str, written: Sequence[tuple[str, str]]) -> DataFrame:
    """(zone, data_set, rows) of the newest snapshots."""
    counts = [
        read_latest(spark, root, zone, name)
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit(zone).alias("zone"), F.lit(name).alias("data_set"), "rows")
        for zone, name in written
    ]
    return reduce(DataFrame.unionByName, counts)
