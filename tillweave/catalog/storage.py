"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillweave.catalog.registry import query
from tillweave.session import scratch_folder
from tillweave.sources import zones
from tillweave.sources.sample_tables import sales_daily, sales_long, table


@query("scan_parquet", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def scan_parquet(spark, data_dir):
    return zones.scan_parquet(spark, f"{data_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"
    )


def _two_snapshots(spark, data_dir) -> str:
    """Customers as written twice: first without, then with their balance."""
    root = scratch_folder(spark, "zones")
    customers = table(spark, data_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    zones.write_zone(customers.drop("c_acctbal"), root, "2.raw", "customers", stamp="20200101_000000_000000")
    zones.write_zone(customers.drop("c_nationkey"), root, "2.raw", "customers", stamp="20200102_000000_000000")
    return root


@query("latest_snapshot", "SELECT c_custkey, c_acctbal FROM customer")
def latest_snapshot(spark, data_dir):
    """The newer of two snapshots with different columns."""
    return zones.read_latest(spark, _two_snapshots(spark, data_dir), "2.raw", "customers")


@query("named_snapshot", "SELECT c_custkey, c_nationkey FROM customer")
def named_snapshot(spark, data_dir):
    """The older of them, by its stamp."""
    root = _two_snapshots(spark, data_dir)
    return zones.read_latest(spark, root, "2.raw", "customers", stamp="20200101_000000_000000")


@query("write_zone", "SELECT id, date, sales FROM sales_long")
def write_zone(spark, data_dir):
    """Write the sparse sales, then the panel as snapshots of one data set; read the newest."""
    root = scratch_folder(spark, "zones")
    panel = sales_long(spark, data_dir).withColumn("sales", F.col("sales").cast("int"))
    zones.write_zone(sales_daily(spark, data_dir), root, "2.raw", "sales_raw", stamp="20200101_000000_000000")
    zones.write_zone(panel, root, "2.raw", "sales_raw", sort_by=["id", "date"])
    return zones.read_latest(spark, root, "2.raw", "sales_raw")


@query(
    "inline_table",
    """SELECT r.region_label, CAST(count(*) AS BIGINT) AS customers
       FROM customer JOIN nation ON c_nationkey = n_nationkey
       JOIN (VALUES (0, 'south'), (1, 'west'), (2, 'east'), (3, 'north'), (4, 'centre')) r(region_no, region_label)
         ON n_regionkey = r.region_no
       GROUP BY r.region_label""",
)
def inline_table(spark, data_dir):
    labels = zones.inline_table(
        spark,
        [(0, "south"), (1, "west"), (2, "east"), (3, "north"), (4, "centre")],
        "region_no int, region_label string",
    )
    nations = table(spark, data_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region_no"))
    return (
        table(spark, data_dir, "customer")
        .join(nations, "c_nationkey")
        .join(labels, "region_no")
        .groupBy("region_label")
        .agg(F.count(F.lit(1)).alias("customers"))
    )


@query(
    "date_spine",
    """SELECT g.date, CAST(count(o_orderkey) AS BIGINT) AS orders
       FROM (SELECT CAST(unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS DATE) AS date FROM orders) g
       LEFT JOIN orders ON CAST(o_orderdate AS DATE) = g.date GROUP BY g.date""",
)
def date_spine(spark, data_dir):
    """Orders per day, days without an order included."""
    days = table(spark, data_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    spine = zones.date_spine(spark, days.agg(F.min("date")).scalar(), days.agg(F.max("date")).scalar())
    daily = days.groupBy("date").agg(F.count(F.lit(1)).alias("orders"))
    return spine.join(daily, "date", "left").na.fill(0, ["orders"])
