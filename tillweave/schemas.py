"""Declared schemas of the external inputs and column-name constants."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed names: the descriptive columns of the wide sales file.
PRODLOC_COLUMNS = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]
DESCRIPTIVE_COLUMNS = ["item_id", "dept_id", "cat_id", "store_id", "state_id"]

# Fixed names: event and benefit-day columns of the calendar.
CALENDAR_EVENT_COLUMNS = ["event_name_1", "event_type_1", "event_name_2", "event_type_2"]
CALENDAR_SNAP_COLUMNS = ["snap_CA", "snap_TX", "snap_WI"]

# Fixed names: weekdays in ISO order.
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]

CALENDAR_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("d", T.StringType()),
        T.StructField("wm_yr_wk", T.IntegerType()),
        T.StructField("weekday", T.StringType()),
        T.StructField("wday", T.IntegerType()),
        *[T.StructField(c, T.StringType()) for c in CALENDAR_EVENT_COLUMNS],
        *[T.StructField(c, T.IntegerType()) for c in CALENDAR_SNAP_COLUMNS],
    ]
)

SELL_PRICES_SCHEMA = T.StructType(
    [
        T.StructField("store_id", T.StringType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("wm_yr_wk", T.IntegerType()),
        T.StructField("sell_price", T.DoubleType()),
    ]
)

SALES_LONG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("sales", T.ShortType()),
    ]
)


def wide_sales_schema(day_count: int) -> T.StructType:
    """Schema of the wide sales file: six descriptive columns, then d_1..d_N."""
    return T.StructType(
        [T.StructField(c, T.StringType()) for c in PRODLOC_COLUMNS]
        + [T.StructField(f"d_{i}", T.IntegerType()) for i in range(1, day_count + 1)]
    )
