"""Equality joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillweave.catalog.registry import query
from tillweave.operators.relational import attach_group_stat, join_tables
from tillweave.sources import sample_tables as tables
from tillweave.sources.sample_tables import table


def customer_side(spark, data_dir):
    return table(spark, data_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_name", "c_mktsegment")


def order_side(spark, data_dir):
    return table(spark, data_dir, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", "o_orderstatus")


def event_side(spark, data_dir):
    """Events by user. Most customers have none, so an outer join has rows to keep."""
    return table(spark, data_dir, "events").select(F.col("user_id").alias("custkey"), "event_id", "event_type")


@query(
    "join_inner",
    """SELECT o_custkey AS custkey, o_orderkey, o_orderstatus, c_name, c_mktsegment
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def join_inner(spark, data_dir):
    return join_tables(order_side(spark, data_dir), customer_side(spark, data_dir), ["custkey"])


@query(
    "join_left",
    """SELECT c_custkey AS custkey, c_name, c_mktsegment, event_id, event_type
       FROM customer LEFT JOIN events ON user_id = c_custkey""",
)
def join_left(spark, data_dir):
    return join_tables(customer_side(spark, data_dir), event_side(spark, data_dir), ["custkey"], "left")


@query(
    "join_right",
    """SELECT c_custkey AS custkey, event_id, event_type, c_name, c_mktsegment
       FROM events RIGHT JOIN customer ON user_id = c_custkey""",
)
def join_right(spark, data_dir):
    return join_tables(event_side(spark, data_dir), customer_side(spark, data_dir), ["custkey"], "right")


@query(
    "join_full",
    """SELECT coalesce(c_custkey, user_id) AS custkey, c_name, c_mktsegment, event_id, event_type
       FROM customer FULL JOIN events ON user_id = c_custkey""",
)
def join_full(spark, data_dir):
    """The key columns of both sides become one."""
    return join_tables(customer_side(spark, data_dir), event_side(spark, data_dir), ["custkey"], "full")


@query(
    "join_semi",
    """SELECT c_custkey AS custkey, c_name, c_mktsegment FROM customer
       WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)""",
)
def join_semi(spark, data_dir):
    return join_tables(customer_side(spark, data_dir), event_side(spark, data_dir), ["custkey"], "semi")


@query(
    "join_anti",
    """SELECT c_custkey AS custkey, c_name, c_mktsegment FROM customer
       WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)""",
)
def join_anti(spark, data_dir):
    return join_tables(customer_side(spark, data_dir), event_side(spark, data_dir), ["custkey"], "anti")


@query("join_cross", "SELECT s_suppkey, s_name, r_name FROM supplier CROSS JOIN region")
def join_cross(spark, data_dir):
    """Every supplier with each of the five regions: the cross join kind itself."""
    suppliers = table(spark, data_dir, "supplier").select("s_suppkey", "s_name")
    return join_tables(suppliers, table(spark, data_dir, "region").select("r_name"), how="cross")


@query(
    "join_multi_key",
    """SELECT p.id, p.item_id, p.store_id, s.wm_yr_wk, s.sell_price
       FROM prodloc p JOIN sell_prices s ON p.item_id = s.item_id AND p.store_id = s.store_id""",
)
def join_multi_key(spark, data_dir):
    keys = tables.prodloc(spark, data_dir).select("id", "item_id", "store_id")
    return join_tables(keys, tables.sell_prices(spark, data_dir), ["item_id", "store_id"])


@query(
    "join_fanout_week_day",
    """SELECT s.store_id, s.item_id, s.wm_yr_wk, s.sell_price, c.date
       FROM sell_prices s LEFT JOIN calendar c ON s.wm_yr_wk = c.wm_yr_wk""",
)
def join_fanout_week_day(spark, data_dir):
    """A weekly price becomes one row per day of its week."""
    days = tables.calendar(spark, data_dir).select("wm_yr_wk", "date")
    return join_tables(tables.sell_prices(spark, data_dir), days, ["wm_yr_wk"], "left")


@query(
    "join_star",
    """SELECT s.id, s.date, s.sales, p.state_id, c.wday, e.events, d.day_sales
       FROM sales_long s JOIN prodloc p ON s.id = p.id JOIN calendar c ON s.date = c.date
       LEFT JOIN (SELECT date, CAST(count(*) AS BIGINT) AS events FROM event_days GROUP BY date) e ON s.date = e.date
       LEFT JOIN (SELECT date, CAST(sum(sales) AS BIGINT) AS day_sales FROM sales_long GROUP BY date) d ON s.date = d.date""",
)
def join_star(spark, data_dir):
    """Facts with dimensions by id and by date."""
    sales = tables.sales_long(spark, data_dir)
    calendar = tables.calendar(spark, data_dir)
    events = (
        calendar.select("date", F.explode(F.array("event_name_1", "event_name_2")).alias("event"))
        .where(F.col("event").isNotNull())
        .groupBy("date")
        .agg(F.count(F.lit(1)).alias("events"))
    )
    day_totals = sales.groupBy("date").agg(F.sum("sales").alias("day_sales"))
    return (
        sales.join(tables.prodloc(spark, data_dir).select("id", "state_id"), "id")
        .join(calendar.select("date", "wday"), "date")
        .join(events, "date", "left")
        .join(day_totals, "date", "left")
    )


@query(
    "join_group_stat",
    """SELECT l_orderkey, l_linenumber, l_quantity, CAST(count(*) OVER (PARTITION BY l_partkey) AS BIGINT) AS part_lines,
              max(l_quantity) OVER (PARTITION BY l_partkey) AS part_max FROM lineitem""",
)
def join_group_stat(spark, data_dir):
    lines = table(spark, data_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return attach_group_stat(
        lines, ["l_partkey"], part_lines=F.count(F.lit(1)), part_max=F.max("l_quantity")
    ).drop("l_partkey")
