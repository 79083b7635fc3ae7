"""Regressor table, design matrix and store panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed names: the columns of the regressor table, in order.
REGRESSOR_COLUMNS = [
    "date",
    "state_id",
    "trend",
    "trend_guassian_splines",
    "wday_guassian_splines",
    "weekday_bool",
    "year_month_trigonometric",
    "holiday_bool",
    "holiday_pre_post_guassian_splines",
    "snap_bool",
]


def regressor_table(
    snap: DataFrame, calendar: DataFrame, flags: DataFrame, windows: DataFrame
) -> DataFrame:
    """One row per date and state with all date features.

    Its size is days x states, whatever the sales volume.
    """
    return (
        snap.withColumnRenamed("state", "state_id")
        .join(calendar, "date", "left")
        .join(flags, "date", "left")
        .join(windows, "date")
        .select(*REGRESSOR_COLUMNS)
    )


def design_matrix(sales: DataFrame, prodloc: DataFrame, regressors: DataFrame) -> DataFrame:
    """Flagged sales with product-location keys and regressors."""
    keys = prodloc.select("id", "item_id", "dept_id", "cat_id", "store_id", "state_id")
    return sales.join(keys, "id").join(regressors, ["date", "state_id"])


def store_panel(sales: DataFrame, prodloc: DataFrame, regressors: DataFrame) -> DataFrame:
    """Sales, out-of-stock count and assortment per date and store, with features.

    Same rows as grouping the design matrix by every feature column. Features
    depend on date and state only, so the facts are summed on two short keys
    first and the features are joined to the small result.
    """
    keys = prodloc.select("id", "store_id", "state_id")
    daily = (
        sales.join(keys, "id")
        .groupBy("date", "state_id", "store_id")
        .agg(
            F.sum("sales").alias("sales"),
            F.sum("OOS").alias("OOS_COUNT"),
            F.count("OOS").alias("ProductPlaces"),
        )
    )
    return daily.join(regressors, ["date", "state_id"])


def store_panel_from_matrix(matrix: DataFrame, regressors: DataFrame) -> DataFrame:
    """The store panel from a written design matrix: its facts are summed, its wide feature columns are not read."""
    daily = matrix.groupBy("date", "state_id", "store_id").agg(
        F.sum("sales").alias("sales"),
        F.sum("OOS").alias("OOS_COUNT"),
        F.count("OOS").alias("ProductPlaces"),
    )
    return daily.join(regressors, ["date", "state_id"])
