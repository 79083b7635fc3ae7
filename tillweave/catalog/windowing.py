"""Window columns, ordering, limits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillweave.catalog.registry import query
from tillweave.operators import panel, relational, windows
from tillweave.plans import panels
from tillweave.sources import sample_tables as tables
from tillweave.sources.sample_tables import table


@query(
    "win_lag_delta",
    "SELECT id, date, sales - lag(sales) OVER (PARTITION BY id ORDER BY date) AS delta FROM sales_long",
)
def win_lag_delta(spark, data_dir):
    return tables.sales_long(spark, data_dir).select(
        "id", "date", windows.lag_delta(F.col("sales"), "id", "date").alias("delta")
    )


@query(
    "win_cum_sum",
    """SELECT id, date, CAST(sum(sales) OVER (PARTITION BY id ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sold_so_far,
              CAST(row_number() OVER (PARTITION BY id ORDER BY date) AS BIGINT) AS trend FROM sales_long""",
)
def win_cum_sum(spark, data_dir):
    return tables.sales_long(spark, data_dir).select(
        "id",
        "date",
        windows.running_sum(F.col("sales"), "id", "date").alias("sold_so_far"),
        windows.running_sum(F.lit(1), "id", "date").alias("trend"),
    )


@query(
    "win_cum_prod",
    """SELECT o_orderkey, step, product(step) OVER (PARTITION BY o_orderkey ORDER BY step ROWS UNBOUNDED PRECEDING) AS running
       FROM (SELECT o_orderkey, CAST(unnest(generate_series(1, n)) AS INTEGER) AS step
             FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey))""",
)
def win_cum_prod(spark, data_dir):
    """Running product of 1..n over the line count of each order."""
    steps = (
        table(spark, data_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count(F.lit(1)).cast("int").alias("n"))
        .select("o_orderkey", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("step"))
    )
    return steps.withColumn("running", windows.running_product(F.col("step"), "o_orderkey", "step"))


@query(
    "win_row_index",
    "SELECT date, weekday, CAST(row_number() OVER (ORDER BY date) - 1 AS BIGINT) AS trend FROM calendar",
)
def win_row_index(spark, data_dir):
    return windows.day_trend(tables.calendar(spark, data_dir).select("date", "weekday"))


@query(
    "win_seq_in_group",
    """SELECT event_name, range, CAST(row_number() OVER (PARTITION BY event_name, date ORDER BY range) - 1 AS INTEGER) AS position, date
       FROM (SELECT event_name, date, CAST(unnest(generate_series(date - 4, date + 4, INTERVAL 1 DAY)) AS DATE) AS range FROM event_days)""",
)
def win_seq_in_group(spark, data_dir):
    """Position of each day in the window around an event."""
    from tillweave.functions.dates import days_around
    from tillweave.operators.summaries import event_days

    near = event_days(tables.calendar(spark, data_dir)).select(
        "event_name", "date", F.explode(days_around(F.col("date"), 4, 4)).alias("range")
    )
    return near.withColumn("position", windows.position_in_group(["event_name", "date"], "range"))


@query(
    "win_cumcount",
    """SELECT store_id, date, sales, CAST(row_number() OVER (PARTITION BY store_id ORDER BY date) - 1 AS INTEGER) AS trend
       FROM (SELECT store_id, date, CAST(sum(sales) AS BIGINT) AS sales FROM sales_long JOIN prodloc USING (id) GROUP BY store_id, date)""",
)
def win_cumcount(spark, data_dir):
    daily = (
        tables.sales_long(spark, data_dir)
        .join(tables.prodloc(spark, data_dir).select("id", "store_id"), "id")
        .groupBy("store_id", "date")
        .agg(F.sum("sales").alias("sales"))
    )
    return daily.withColumn("trend", windows.position_in_group("store_id", "date"))


@query(
    "win_rolling_std_rows",
    """SELECT id, date, CASE WHEN count(*) OVER w = 7 THEN round(stddev_samp(sales) OVER w, 6) END AS rolling_std
       FROM sales_long WINDOW w AS (PARTITION BY id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def win_rolling_std_rows(spark, data_dir):
    return tables.sales_long(spark, data_dir).select(
        "id", "date", F.round(windows.rolling_std_rows(F.col("sales"), "id", "date", 7), 6).alias("rolling_std")
    )


@query(
    "win_rolling_std_days",
    """SELECT store_id, date, round(stddev_samp(sales) OVER (PARTITION BY store_id ORDER BY date
              RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW), 6) AS rolling_std, sales
       FROM (SELECT store_id, date, CAST(sum(quantity) AS BIGINT) AS sales FROM sales_lines GROUP BY ALL)""",
)
def win_rolling_std_days(spark, data_dir):
    """Daily store sales over the last 30 days; days without a line are missing."""
    daily = (
        tables.sales_lines(spark, data_dir)
        .groupBy("store_id", "date")
        .agg(F.sum("quantity").alias("sales"))
    )
    return daily.withColumn("rolling_std", F.round(windows.rolling_std_days("sales", "store_id", "date", 30), 6))


@query(
    "win_linear_ramp",
    """SELECT id, date, round(0.2 + coalesce(CAST(row_number() OVER (PARTITION BY id ORDER BY date) - 1 AS DOUBLE)
              / nullif(count(*) OVER (PARTITION BY id) - 1, 0), 0) * 0.8, 9) AS weight FROM sales_trim""",
)
def win_linear_ramp(spark, data_dir):
    trimmed = tables.sales_long(spark, data_dir).transform(panel.trim_before_first_sale)
    return trimmed.select("id", "date", F.round(windows.linear_ramp(0.2, 1.0, "id", "date"), 9).alias("weight"))


@query(
    "win_zero_runs",
    "SELECT s.id, s.date, s.zero_sales_ind, p.period AS zero_sales_period FROM zero_rows s JOIN zero_periods p USING (id, date)",
)
def win_zero_runs(spark, data_dir):
    trimmed = tables.sales_long(spark, data_dir).transform(panel.trim_before_first_sale)
    return panel.zero_sales_runs(trimmed).select("id", "date", "zero_sales_ind", "zero_sales_period")


@query("sort_rows", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def sort_rows(spark, data_dir):
    return (
        table(spark, data_dir, "orders")
        .select("o_orderkey", "o_custkey", "o_totalprice")
        .orderBy(F.desc("o_totalprice"), "o_orderkey")
    )


@query("sort_by_expr", "SELECT id, date, sales FROM sales_long ORDER BY id, date")
def sort_by_expr(spark, data_dir):
    """All columns by entity and time."""
    return panels.sort_panel(tables.sales_long(spark, data_dir), "id", "date")


@query(
    "limit_rows",
    """SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units FROM lineitem GROUP BY l_partkey
       ORDER BY units DESC, l_partkey LIMIT 10""",
)
def limit_rows(spark, data_dir):
    """The ten best-selling parts."""
    return (
        table(spark, data_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(F.sum(F.col("l_quantity").cast("long")).alias("units"))
        .orderBy(F.desc("units"), "l_partkey")
        .limit(10)
    )


@query("sample_n", "SELECT id FROM (SELECT DISTINCT id FROM prodloc) ORDER BY md5('42,' || id), id LIMIT 15")
def sample_n(spark, data_dir):
    """Fifteen distinct ids, the same ones for the same seed."""
    return relational.sample_rows(tables.prodloc(spark, data_dir).select("id").distinct(), 15, seed=42)
