"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillweave.catalog.registry import query
from tillweave.functions import maths, metrics
from tillweave.operators import sketches, summaries
from tillweave.operators.reshape import list_of
from tillweave.session import scratch_folder
from tillweave.sources import sample_tables as tables
from tillweave.sources import zones
from tillweave.sources.sample_tables import table


@query(
    "agg_sum_min_max",
    """SELECT id, CAST(sum(sales) AS BIGINT) AS total_sales, min(date) AS first_date, max(date) AS last_date
       FROM sales_long WHERE sales > 0 GROUP BY id""",
)
def agg_sum_min_max(spark, data_dir):
    return (
        tables.sales_long(spark, data_dir)
        .where("sales > 0")
        .groupBy("id")
        .agg(F.sum("sales").alias("total_sales"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    )


@query(
    "agg_mean_count",
    """SELECT l_partkey, avg(l_quantity) AS mean_quantity, CAST(count(*) AS BIGINT) AS lines,
              CAST(count(CASE WHEN l_tax > 0 THEN 1 END) AS BIGINT) AS taxed FROM lineitem GROUP BY l_partkey""",
)
def agg_mean_count(spark, data_dir):
    return (
        table(spark, data_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(
            F.avg("l_quantity").alias("mean_quantity"),
            F.count(F.lit(1)).alias("lines"),
            F.count(F.when(F.col("l_tax") > 0, 1)).alias("taxed"),
        )
    )


@query(
    "agg_filtered",
    """SELECT id, min(date) FILTER (WHERE sales > 0) AS first_tran_dt, max(date) FILTER (WHERE sales > 0) AS last_tran_dt,
              max(date) AS dataset_last_dt, CAST(count(*) FILTER (WHERE sales > 0) AS BIGINT) AS selling_days
       FROM sales_long GROUP BY id""",
)
def agg_filtered(spark, data_dir):
    sold = F.col("sales") > 0
    return (
        tables.sales_long(spark, data_dir)
        .groupBy("id")
        .agg(
            F.min(F.when(sold, F.col("date"))).alias("first_tran_dt"),
            F.max(F.when(sold, F.col("date"))).alias("last_tran_dt"),
            F.max("date").alias("dataset_last_dt"),
            F.count_if(sold).alias("selling_days"),
        )
    )


@query(
    "agg_all_columns",
    """SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS l_quantity,
              CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS discount_points FROM lineitem GROUP BY l_returnflag""",
)
def agg_all_columns(spark, data_dir):
    """Sum of every numeric column that is not a key."""
    lines = table(spark, data_dir, "lineitem").select(
        "l_returnflag",
        "l_linenumber",
        F.col("l_quantity").cast("long").alias("l_quantity"),
        F.round(F.col("l_discount") * 100).cast("long").alias("discount_points"),
    )
    return summaries.sum_all(lines, ["l_returnflag"])


@query(
    "agg_count_distinct",
    """SELECT o_orderpriority, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers,
              CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS statuses FROM orders GROUP BY o_orderpriority""",
)
def agg_count_distinct(spark, data_dir):
    return (
        table(spark, data_dir, "orders")
        .groupBy("o_orderpriority")
        .agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_orderstatus").alias("statuses"))
    )


@query(
    "agg_collect_list",
    """SELECT event_name, string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) AS dates, CAST(count(*) AS BIGINT) AS n
       FROM event_days GROUP BY event_name""",
)
def agg_collect_list(spark, data_dir):
    """Dates of each event, shown as text; bounded by the calendar."""
    calendar = tables.calendar(spark, data_dir)
    return (
        summaries.event_days(calendar)
        .groupBy("event_name")
        .agg(list_of("date").alias("dates"))
        .select("event_name", F.array_join(F.col("dates").cast("array<string>"), ",").alias("dates"), F.size("dates").cast("long").alias("n"))
    )


@query(
    "agg_collect_set",
    """SELECT o_orderpriority, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses,
              CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS n FROM orders GROUP BY o_orderpriority""",
)
def agg_collect_set(spark, data_dir):
    """Duplicates go on the map side, so a group's list holds distinct values only."""
    return (
        table(spark, data_dir, "orders")
        .select("o_orderpriority", "o_orderstatus")
        .distinct()
        .groupBy("o_orderpriority")
        .agg(list_of("o_orderstatus", distinct=True).alias("statuses"))
        .select("o_orderpriority", F.array_join("statuses", ",").alias("statuses"), F.size("statuses").cast("long").alias("n"))
    )


@query(
    "agg_median_var_std",
    """SELECT id, median(sales) AS median_sales, round(var_samp(sales), 6) AS var_sales, round(stddev_samp(sales), 6) AS std_sales
       FROM sales_long GROUP BY id""",
)
def agg_median_var_std(spark, data_dir):
    return (
        tables.sales_long(spark, data_dir)
        .groupBy("id")
        .agg(
            F.median("sales").alias("median_sales"),
            F.round(F.var_samp("sales"), 6).alias("var_sales"),
            F.round(F.stddev_samp("sales"), 6).alias("std_sales"),
        )
    )


@query(
    "agg_ratio",
    """SELECT l_suppkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS DOUBLE) / sum(l_quantity) * 100 AS pct_returned
       FROM lineitem GROUP BY l_suppkey""",
)
def agg_ratio(spark, data_dir):
    returned = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0))
    return (
        table(spark, data_dir, "lineitem")
        .groupBy("l_suppkey")
        .agg((maths.safe_divide(returned, F.sum("l_quantity")) * 100).alias("pct_returned"))
    )


@query(
    "agg_log",
    """SELECT o_custkey, round(ln(sum(abs(o_totalprice))), 6) AS ln_sum, round(ln(avg(abs(o_totalprice))), 6) AS ln_mean,
              round(log10(sum(o_totalprice)), 6) AS log10_sum FROM orders GROUP BY o_custkey""",
)
def agg_log(spark, data_dir):
    price = F.col("o_totalprice")
    return (
        table(spark, data_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            F.round(maths.safe_log(F.sum(F.abs(price))), 6).alias("ln_sum"),
            F.round(maths.safe_log(F.avg(F.abs(price))), 6).alias("ln_mean"),
            F.round(maths.safe_log10(F.sum(price)), 6).alias("log10_sum"),
        )
    )


@query(
    "agg_by_all_but",
    """SELECT s.date, p.store_id, c.wday, c.snap_CA, CAST(sum(s.sales) AS BIGINT) AS sales, CAST(count(*) AS BIGINT) AS rows_in_group
       FROM sales_long s JOIN prodloc p ON s.id = p.id JOIN calendar c ON s.date = c.date GROUP BY ALL""",
)
def agg_by_all_but(spark, data_dir):
    """Group by everything but the measures, a struct among the keys."""
    rows = (
        tables.sales_long(spark, data_dir)
        .join(tables.prodloc(spark, data_dir).select("id", "store_id"), "id")
        .join(tables.calendar(spark, data_dir).select("date", F.struct("wday", "snap_CA").alias("day")), "date")
        .select("date", "store_id", "day", "sales")
    )
    return summaries.group_by_all_but(
        rows, ["sales"], F.sum("sales").alias("sales"), F.count(F.lit(1)).alias("rows_in_group")
    ).select("date", "store_id", "day.*", "sales", "rows_in_group")


@query(
    "agg_global",
    """SELECT avg(l_quantity) AS mean_quantity, CAST(count(*) AS BIGINT) AS lines, max(l_extendedprice) AS top_price,
              round(var_samp(l_quantity), 6) AS var_quantity FROM lineitem""",
)
def agg_global(spark, data_dir):
    return table(spark, data_dir, "lineitem").agg(
        F.avg("l_quantity").alias("mean_quantity"),
        F.count(F.lit(1)).alias("lines"),
        F.max("l_extendedprice").alias("top_price"),
        F.round(F.var_samp("l_quantity"), 6).alias("var_quantity"),
    )


@query("distinct_rows", "SELECT DISTINCT l_partkey, l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, data_dir):
    return table(spark, data_dir, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus").distinct()


@query(
    "agg_quantile",
    """SELECT l_suppkey, quantile_disc(l_quantity, 0.01) AS q01, quantile_disc(l_quantity, 0.5) AS q50, quantile_disc(l_quantity, 0.99) AS q99
       FROM lineitem GROUP BY l_suppkey""",
)
def agg_quantile(spark, data_dir):
    return summaries.grouped_quantiles(
        table(spark, data_dir, "lineitem"), ["l_suppkey"], "l_quantity", {"q01": 0.01, "q50": 0.5, "q99": 0.99}
    )


@query(
    "agg_factorial",
    """SELECT o_orderkey, CAST(n AS INTEGER) AS lines, round(exp(lgamma(n + 1))) AS factorial
       FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)""",
)
def agg_factorial(spark, data_dir):
    """n! of the line count."""
    lines = (
        table(spark, data_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count(F.lit(1)).cast("int").alias("lines"))
    )
    return lines.withColumn("factorial", maths.factorial(F.col("lines")))


@query(
    "metrics_forecast",
    """SELECT id, round(sum(abs(y - f)) / sum(y), 6) AS wape, round(sqrt(avg((y - f) * (y - f))), 6) AS rmse,
              round(sum(f) / sum(y), 6) AS bias, round(avg((y - f) * (y - f)), 6) AS mse, round(avg(abs(y - f)), 6) AS mae,
              round(avg(abs(y - f) / y) FILTER (WHERE y <> 0) * 100, 6) AS mape
       FROM (SELECT id, CAST(sales AS DOUBLE) AS y, CAST(lag(sales, 7) OVER (PARTITION BY id ORDER BY date) AS DOUBLE) AS f FROM sales_long)
       WHERE f IS NOT NULL GROUP BY id""",
)
def metrics_forecast(spark, data_dir):
    """Errors of a forecast by the value of one week earlier."""
    from pyspark.sql import Window

    week_ago = F.lag("sales", 7).over(Window.partitionBy("id").orderBy("date"))
    pairs = (
        tables.sales_long(spark, data_dir)
        .select("id", F.col("sales").cast("double").alias("y"), week_ago.cast("double").alias("f"))
        .where(F.col("f").isNotNull())
    )
    y, f = F.col("y"), F.col("f")
    measures = {
        "wape": metrics.wape(y, f),
        "rmse": metrics.rmse(y, f),
        "bias": metrics.bias(y, f),
        "mse": metrics.mse(y, f),
        "mae": metrics.mae(y, f),
        "mape": metrics.mape(y, f),
    }
    return pairs.groupBy("id").agg(*[F.round(m, 6).alias(n) for n, m in measures.items()])


@query(
    "describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
            min({c}) AS min, quantile_disc({c}, 0.25) AS q25, quantile_disc({c}, 0.5) AS q50, quantile_disc({c}, 0.75) AS q75, max({c}) AS max FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
)
def describe(spark, data_dir):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return summaries.describe(table(spark, data_dir, "lineitem"), columns, digits=6)


@query(
    "agg_distinct_sketches",
    """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, true AS within_bound
       FROM lineitem GROUP BY ALL""",
)
def agg_distinct_sketches(spark, data_dir):
    """Distinct parts per month from stored sketches per day, beside the exact count."""
    lines = table(spark, data_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"), "l_partkey")
    root = scratch_folder(spark, "sketches")
    zones.write_zone(sketches.distinct_sketches(lines, ["date"], "l_partkey"), root, "3.interim", "part_sketches")
    month = F.trunc("date", "month").alias("month")
    estimates = sketches.rolled_up(zones.read_latest(spark, root, "3.interim", "part_sketches"), month)
    exact = lines.groupBy(month).agg(F.count_distinct("l_partkey").alias("parts"))
    near = F.abs(F.col("estimate") - F.col("parts")) <= sketches.error_bound(F.col("parts"))
    return exact.join(estimates, "month").select("month", "parts", near.alias("within_bound"))
