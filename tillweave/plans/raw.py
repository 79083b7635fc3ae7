"""External files to the raw zone."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillweave.operators.relational import join_tables
from tillweave.operators.reshape import melt_wide
from tillweave.schemas import DESCRIPTIVE_COLUMNS, PRODLOC_COLUMNS


def sales_raw(wide: DataFrame, calendar: DataFrame, how: str = "left") -> DataFrame:
    """Wide sales file to (id, date, sales).

    One scan and one explode; the calendar, a few thousand rows, is joined on
    the day name. Days missing from the calendar keep a null date, or vanish
    with ``how="inner"``.
    """
    long = melt_wide(wide, "id", DESCRIPTIVE_COLUMNS, name_col="d", value_col="sales")
    return join_tables(long, calendar.select("d", "date"), ["d"], how).select("id", "date", "sales")


def prodloc_raw(wide: DataFrame) -> DataFrame:
    """The descriptive columns of the wide file."""
    return wide.select(*PRODLOC_COLUMNS)


def price_daily(prices: DataFrame, prodloc: DataFrame, calendar: DataFrame) -> DataFrame:
    """Weekly store-item prices to (id, date, sell_price).

    Prices of unknown product-locations or weeks stay, with null id or date.
    """
    located = join_tables(prices, prodloc.select("id", "item_id", "store_id"), ["item_id", "store_id"], "left")
    return join_tables(located, calendar.select("wm_yr_wk", "date"), ["wm_yr_wk"], "left").select(
        "id", "date", "sell_price"
    )


def calendar_raw(calendar: DataFrame) -> DataFrame:
    """The calendar as it is."""
    return calendar
