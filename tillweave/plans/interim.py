"""Raw zone to interim zone: product life cycles and cleaned sales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.functions.dates import date_span
from tillweave.operators.panel import flag_out_of_stock, series_lifecycle, trim_before_first_sale

# Fixed value: the threshold of the production flow.
LIVE_THRESHOLD = 0.0001


def last_date(sales: DataFrame, date_col: str = "date") -> Column:
    """Last date of the data as a scalar subquery."""
    return sales.agg(F.max(date_col)).scalar()


def prodloc_lifecycle(prodloc: DataFrame, sales: DataFrame, end: Column | None = None) -> DataFrame:
    """Product-locations with first and last sale, units and the dates on sale.

    ``prodloc_daterange`` runs from the first sale to ``end`` (the last date of
    the data if not given). Ids never sold disappear.
    """
    end = end if end is not None else last_date(sales)
    cycle = series_lifecycle(sales).withColumn(
        "prodloc_daterange", date_span(F.col("first_sales_date"), end)
    )
    return prodloc.join(cycle, "id")


def prodloc_lifecycle_full(prodloc: DataFrame, sales: DataFrame, end: Column | None = None) -> DataFrame:
    """The same over all rows: ids never sold stay, with null dates."""
    end = end if end is not None else last_date(sales)
    sold_on = F.when(F.col("sales") > 0, F.col("date"))
    cycle = sales.groupBy("id").agg(
        F.min(sold_on).alias("first_tran_dt"),
        F.max(sold_on).alias("last_tran_dt"),
        F.max("date").alias("dataset_last_dt"),
        F.sum("sales").alias("total_unit_sales"),
    )
    return prodloc.join(cycle, "id").withColumn(
        "timeseries_daterange", date_span(F.col("first_tran_dt"), end)
    )


def sales_interim(sales: DataFrame, threshold: float = LIVE_THRESHOLD, end: Column | None = None) -> DataFrame:
    """Panel from first sale on with zero-sales and out-of-stock flags.

    Trimming and flagging share one shuffle by id.
    """
    return sales.transform(trim_before_first_sale, end).transform(flag_out_of_stock, threshold)
