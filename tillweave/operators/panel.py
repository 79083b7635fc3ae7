"""Operators on the long panel (id, date, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillweave.functions.dates import date_span


def series_window(id_col: str | list[str], date_col: str):
    """Rows of one series in date order.

    A panel has one row per id and day, so a series is never longer than the
    date range: no window group grows with the data volume.
    """
    return Window.partitionBy(id_col).orderBy(date_col)


def densify_daily(
    df: DataFrame,
    first_day: Column,
    last_day: Column,
    id_col: str = "id",
    date_col: str = "date",
    value_col: str = "sales",
) -> DataFrame:
    """Fill missing days of each series with 0, from first_day to last_day.

    Every row is stretched to the day before the next one, so the gaps come
    from one window over the sparse rows: no id-by-day product and no join.
    Input needs one row per id and day.
    """
    w = series_window(id_col, date_col)
    day = F.col(date_col)
    start = F.when(F.lag(day).over(w).isNull(), F.least(first_day, day)).otherwise(day)
    stop = F.coalesce(F.date_sub(F.lead(day).over(w), 1), F.greatest(last_day, day))
    stretched = df.select(id_col, day, F.col(value_col), start.alias("_start"), stop.alias("_stop"))
    return stretched.select(
        id_col,
        F.explode(date_span(F.col("_start"), F.col("_stop"))).alias("_day"),
        day.alias("_seen"),
        value_col,
    ).select(
        id_col,
        F.col("_day").alias(date_col),
        F.when(F.col("_day") == F.col("_seen"), F.col(value_col)).otherwise(0).alias(value_col),
    )


def series_lifecycle(
    df: DataFrame, id_col: str = "id", date_col: str = "date", target_col: str = "sales"
) -> DataFrame:
    """First and last day with a sale and total units, for ids ever sold."""
    return (
        df.where(F.col(target_col) > 0)
        .groupBy(id_col)
        .agg(
            F.min(date_col).alias("first_sales_date"),
            F.max(date_col).alias("last_sales_date"),
            F.sum(target_col).alias("total_sales"),
        )
    )


def trim_before_first_sale(
    df: DataFrame,
    end: Column | None = None,
    id_col: str = "id",
    date_col: str = "date",
    target_col: str = "sales",
) -> DataFrame:
    """Keep each series from its first sale on, up to ``end`` if given.

    Same rows as joining to an exploded list of dates, without the list and
    the join. Series that never sold vanish.
    """
    first = F.min(F.when(F.col(target_col) > 0, F.col(date_col))).over(Window.partitionBy(id_col))
    kept = F.col(date_col) >= F.col("_first")
    if end is not None:
        kept = kept & (F.col(date_col) <= end)
    return df.withColumn("_first", first).where(kept).drop("_first")


def zero_sales_runs(
    df: DataFrame,
    id_col: str = "id",
    date_col: str = "date",
    target_col: str = "sales",
) -> DataFrame:
    """Number the runs of consecutive zero-sales rows of each series.

    Adds ``zero_sales_ind`` and ``zero_sales_period``: the n-th run has period
    n, rows with sales have 0. In a series that starts with zeros the first
    row has a null period and the rest of that run has period 0.
    """
    w = series_window(id_col, date_col)
    zero = F.col("zero_sales_ind")
    change = zero - F.lag(zero, 1).over(w)
    running = F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        df.withColumn("zero_sales_ind", F.when(F.col(target_col) == 0, 1).otherwise(0))
        .withColumn("_start", F.when(change == -1, 0).otherwise(change))
        .withColumn("zero_sales_period", running * zero)
        .drop("_start")
    )


def flag_out_of_stock(
    df: DataFrame,
    threshold: float = 0.001,
    ids: list[str] | None = None,
    id_col: str = "id",
    date_col: str = "date",
    target_col: str = "sales",
    keep_detail: bool = False,
) -> DataFrame:
    """Mark zero-sales runs that are too long to be chance.

    With p the share of zero rows of a series, a run of k zero rows is out of
    stock when p^k <= threshold. Adds ``zero_sales_ind`` and ``OOS``, and with
    ``keep_detail`` also the period, p and k. All windows share the partition
    by id, so the panel is shuffled once.
    """
    if ids is not None:
        df = df.where(F.col(id_col).isin(ids))
    run = Window.partitionBy(id_col, "zero_sales_period")
    flagged = (
        df.transform(zero_sales_runs, id_col, date_col, target_col)
        .withColumn("prob_zero_sales", F.avg("zero_sales_ind").over(Window.partitionBy(id_col)))
        .withColumn("nbr_zero_sales_in_a_row", F.sum("zero_sales_ind").over(run))
        .withColumn(
            "OOS",
            F.when(
                (F.col("zero_sales_ind") == 1)
                & F.col("zero_sales_period").isNotNull()
                & (F.pow("prob_zero_sales", "nbr_zero_sales_in_a_row") <= threshold),
                1,
            ).otherwise(0),
        )
    )
    if keep_detail:
        return flagged
    return flagged.drop("zero_sales_period", "prob_zero_sales", "nbr_zero_sales_in_a_row")
