"""Panels and reports on top of the flagged sales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillweave.functions.maths import safe_divide, safe_log10
from tillweave.functions.text import join_text, take_parts
from tillweave.operators.windows import position_in_group, running_sum


def sort_panel(df: DataFrame, entity_col: str, time_col: str) -> DataFrame:
    return df.orderBy(entity_col, time_col)


def with_hierarchy(sales: DataFrame) -> DataFrame:
    """Hierarchy levels read from the id string."""
    key = F.col("id")
    return sales.withColumns(
        {
            "department": take_parts(key, [1]),
            "category_dep": take_parts(key, [0, 1]),
            "state_store": take_parts(key, [3, 4]),
        }
    )


def hierarchy_panel(sales: DataFrame) -> DataFrame:
    """Sums, means and counts per category-department, store and day."""
    return (
        with_hierarchy(sales)
        .groupBy("category_dep", "state_store", "date")
        .agg(
            F.sum("sales").alias("sales"),
            F.avg("sales").alias("mean_sales"),
            F.count(F.lit(1)).alias("prodloc_count"),
            F.sum("zero_sales_ind").alias("zero_sales_ind"),
            F.avg("zero_sales_ind").alias("mean_zero_sales_ind"),
            F.sum("OOS").alias("OOS"),
            F.avg("OOS").alias("mean_OOS"),
        )
    )


def oos_report(sales: DataFrame, digits: int | None = None) -> DataFrame:
    """Seventeen measures of zero and out-of-stock days per hierarchy level.

    One aggregation. Medians keep one counter per distinct sales value, which
    the small-integer type bounds.
    """
    sold, zero, oos = F.col("sales"), F.sum("zero_sales_ind"), F.sum("OOS")
    rows, in_stock = F.count("zero_sales_ind"), F.when(F.col("OOS") == 0, F.col("sales"))

    def shown(column):
        return column if digits is None else F.round(column, digits)

    return (
        with_hierarchy(sales)
        .groupBy("department", "category_dep", "state_store")
        .agg(
            shown(safe_divide(oos, zero) * 100).alias("pct_oos_of_zero_sale"),
            shown(safe_divide(oos, rows) * 100).alias("pct_oos_of_total_sales"),
            shown(safe_divide(zero, rows) * 100).alias("pct_zero_of_total_sales"),
            oos.alias("oos_zero_sale"),
            (zero - oos).alias("non_oss_zero_sale"),
            zero.alias("zero_sales_ind"),
            (rows - zero).alias("sales_ind"),
            rows.alias("count_possible_sale"),
            shown(F.avg(sold)).alias("mean"),
            shown(F.avg(in_stock)).alias("mean_excl_oos"),
            F.median(sold).alias("median"),
            F.median(in_stock).alias("median_excl_oos"),
            shown(safe_log10(F.sum(sold))).alias("log10Sum"),
            shown(F.var_samp(sold)).alias("var"),
            shown(F.var_samp(in_stock)).alias("var_excl_oos"),
            shown(F.stddev_samp(sold)).alias("std"),
            shown(F.stddev_samp(in_stock)).alias("std_excl_oos"),
        )
    )


def oos_share(sales: DataFrame) -> DataFrame:
    """Out-of-stock days over zero-sales days, one row."""
    return sales.agg(safe_divide(F.sum("OOS"), F.sum("zero_sales_ind")).alias("oos_share"))


def sales_by_day(sales: DataFrame) -> DataFrame:
    return sales.groupBy("date").agg(F.sum("sales").alias("total_sales"))


def sales_by_region(sales: DataFrame, prodloc: DataFrame) -> DataFrame:
    return (
        sales.join(prodloc.select("id", "state_id"), "id")
        .groupBy("state_id", "date")
        .agg(F.sum("sales").alias("sales"))
    )


def assortment_size(sales: DataFrame, prodloc: DataFrame) -> DataFrame:
    """Product-locations with a sale per day and state, from trimmed sales."""
    return (
        sales.join(prodloc.select("id", "state_id"), "id")
        .groupBy("date", "state_id")
        .agg(F.count_if(F.col("sales") > 0).alias("Nbr_unique_selling_prodlocs"))
    )


def assortment_size_store(sales: DataFrame, prodloc: DataFrame) -> DataFrame:
    """The same per store, with the store key split and a running row number."""
    key = F.col("store_id")
    return (
        sales.join(prodloc.select("id", "state_id", "store_id"), "id")
        .groupBy("date", "store_id", "state_id")
        .agg(F.count_if(F.col("sales") > 0).alias("Nbr_unique_selling_prodlocs"))
        .withColumns({"state": take_parts(key, [0]), "store": take_parts(key, [1])})
        .withColumn("trend", position_in_group(["state", "store"], "date"))
    )


def category_state_panel(sales: DataFrame, prodloc: DataFrame, event_features: DataFrame) -> DataFrame:
    """Daily sales per category and state with event features and a trend.

    ``event_features`` has a date and one struct per event.
    """
    daily = (
        sales.join(prodloc.select("id", "cat_id", "state_id"), "id", "left")
        .groupBy("date", "cat_id", "state_id")
        .agg(F.sum("sales").alias("sales"))
    )
    key = join_text(F.col("cat_id"), "_", F.col("state_id")).alias("Cat_state_id")
    return (
        daily.select(key, "date", "sales", F.lit(1).alias("constant"))
        .withColumn("trend", running_sum(F.col("constant"), "Cat_state_id", "date"))
        .join(event_features, "date", "left")
    )
