"""Retail inputs built from order-line tables.

The engine's inputs are a wide sales file, a calendar, weekly prices and the
product-location dimension. These adapters derive all of them from the tables
``lineitem`` and ``part``:

* a product-location is a brand sold in a store; its id has the form
  ``CAT_DEPT_ITEM_STATE_STORE_evaluation``;
* a brand is launched 30 days x its number after the first ship date, so that
  series start with zeros before launch;
* sales are summed line quantities per day, with 0 on days without a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillweave.operators.panel import densify_daily
from tillweave.schemas import PRODLOC_COLUMNS, wide_sales_schema
from tillweave.session import scratch_folder

LAUNCH_STEP_DAYS = 30

# Department of a brand number, one department per five brands.
DEPARTMENTS = ["FOODS_1", "FOODS_2", "HOUSEHOLD_1", "HOUSEHOLD_2", "HOBBIES_1"]
BRANDS_PER_DEPARTMENT = 5


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def ship_dates(spark: SparkSession, data_dir: str, daily: DataFrame | None = None) -> DataFrame:
    """(date): the ship dates of all order lines, repeated or, from ``daily_lines``, once per day and key."""
    if daily is not None:
        return daily.select("date")
    return table(spark, data_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"))


def date_bounds(spark: SparkSession, data_dir: str, daily: DataFrame | None = None) -> tuple[Column, Column]:
    """First and last ship date as scalar subqueries; nothing runs here."""
    ship = ship_dates(spark, data_dir, daily)
    return ship.agg(F.min("date")).scalar(), ship.agg(F.max("date")).scalar()


# Short keys of a product-location, used up to the first aggregation.
SHORT_KEYS = ["brand_no", "state_id", "store_no"]


def _short_lines(spark: SparkSession, data_dir: str, how: str) -> DataFrame:
    """Order lines with short keys, ship date, quantity and cents; ``known`` is null on lines without a part."""
    lines = table(spark, data_dir, "lineitem").select(
        F.col("l_partkey").alias("part"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.expr(
            "CASE l_returnflag WHEN 'R' THEN 'CA' WHEN 'A' THEN 'TX' ELSE 'WI' END"
        ).alias("state_id"),
        F.expr("CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 2 ELSE 1 END").alias("store_no"),
    )
    parts = table(spark, data_dir, "part").select(
        F.col("p_partkey").alias("part"),
        F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int").alias("brand_no"),
        F.lit(True).alias("known"),
    )
    return lines.join(parts, "part", how)


def daily_lines(spark: SparkSession, data_dir: str) -> DataFrame:
    """Order lines summed per short keys and ship date, written once and read back.

    The other adapters take it as ``daily`` and give the same tables, so that a job that needs several of them reads the
    lines once. Its size is that of the panel, whatever the number of lines. Lines without a part are kept, as they count
    for the range of dates.
    """
    summed = (
        _short_lines(spark, data_dir, "left")
        .groupBy(*SHORT_KEYS, "known", "date")
        .agg(F.sum("quantity").alias("quantity"), F.sum("cents").alias("cents"))
    )
    path = scratch_folder(spark, "lines") + "/daily_lines"
    summed.write.parquet(path)
    return spark.read.schema(summed.schema).parquet(path)


def short_lines(spark: SparkSession, data_dir: str, daily: DataFrame | None = None) -> DataFrame:
    """Order lines with short keys, ship date, quantity and cents; from ``daily_lines`` their daily sums."""
    lines = _short_lines(spark, data_dir, "inner") if daily is None else daily.where("known")
    return lines.drop("known")


def with_names(df: DataFrame) -> DataFrame:
    """Add the id and its parts to rows that carry the short keys."""
    department = F.element_at(
        F.array(*[F.lit(d) for d in DEPARTMENTS]),
        F.expr(f"(brand_no - 1) div {BRANDS_PER_DEPARTMENT} + 1").cast("int"),
    )
    return (
        df.withColumn("dept_id", department)
        .withColumn("cat_id", F.substring_index("dept_id", "_", 1))
        .withColumn("item_id", F.concat("dept_id", F.lit("_"), F.lpad(F.col("brand_no").cast("string"), 3, "0")))
        .withColumn("store_id", F.concat("state_id", F.lit("_"), F.col("store_no").cast("string")))
        .withColumn("id", F.concat("item_id", F.lit("_"), "store_id", F.lit("_evaluation")))
    )


def sales_lines(spark: SparkSession, data_dir: str) -> DataFrame:
    """Order lines with product-location keys, ship date, quantity and cents."""
    return with_names(short_lines(spark, data_dir))


def prodloc(spark: SparkSession, data_dir: str, daily: DataFrame | None = None) -> DataFrame:
    """One row per product-location."""
    return with_names(short_lines(spark, data_dir, daily).select(*SHORT_KEYS).distinct()).select(*PRODLOC_COLUMNS)


def sales_daily(spark: SparkSession, data_dir: str, daily: DataFrame | None = None) -> DataFrame:
    """Units per product-location and day with a line; 0 before launch."""
    first_day, _ = date_bounds(spark, data_dir, daily)
    launched = F.col("date") >= F.date_add(first_day, F.col("brand_no") * LAUNCH_STEP_DAYS)
    units = (
        short_lines(spark, data_dir, daily)
        .groupBy(*SHORT_KEYS, "date")
        .agg(F.sum("quantity").cast("int").alias("units"))
    )
    return with_names(units).select("id", "date", F.when(launched, F.col("units")).otherwise(0).alias("sales"))


def sales_long(spark: SparkSession, data_dir: str, daily: DataFrame | None = None) -> DataFrame:
    """Dense panel (id, date, sales): every id on every day of the range."""
    first_day, last_day = date_bounds(spark, data_dir, daily)
    return densify_daily(sales_daily(spark, data_dir, daily), first_day, last_day)


def sales_wide(spark: SparkSession, data_dir: str) -> DataFrame:
    """Wide file: descriptive columns and one column per day, d_1 .. d_N.

    Written as a file and read back, as the external input is a file: the
    thousands of columns then stay out of the plans that build it. The day
    count is read first (one number), because column names are part of a plan.
    A row holds one value per day of the range, whatever the volume.
    """
    first_day, last_day = date_bounds(spark, data_dir)
    days = spark.range(1).select((F.datediff(last_day, first_day) + 1).alias("n")).first()["n"]
    series = (
        sales_long(spark, data_dir)
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("date", "sales"))).alias("days"))
        .select("id", F.col("days.sales").alias("units"))
    )
    path = scratch_folder(spark, "wide") + "/sales_wide"
    (
        prodloc(spark, data_dir)
        .join(series, "id")
        .selectExpr(*PRODLOC_COLUMNS, *[f"units[{i}] AS d_{i + 1}" for i in range(days)])
        .write.parquet(path)
    )
    return spark.read.schema(wide_sales_schema(days)).parquet(path)


def sell_prices(spark: SparkSession, data_dir: str, daily: DataFrame | None = None) -> DataFrame:
    """Unit price per store, item and week with a sale."""
    first_day, _ = date_bounds(spark, data_dir, daily)
    weekly = (
        short_lines(spark, data_dir, daily)
        .groupBy(*SHORT_KEYS, F.floor(F.datediff("date", first_day) / 7).cast("int").alias("wm_yr_wk"))
        .agg((F.sum("cents") / (F.lit(100.0) * F.sum("quantity"))).alias("sell_price"))
    )
    return with_names(weekly).select("store_id", "item_id", "wm_yr_wk", "sell_price")


# Fixed rules for the events of the calendar: name, type and the condition on
# month m, day of month dd and ISO weekday wd. The last one fills the second
# event columns, as it falls on the day of another event.
EVENT_RULES = [
    ("Christmas", "National", "m = 12 AND dd = 25"),
    ("IndependenceDay", "National", "m = 7 AND dd = 4"),
    ("Thanksgiving", "National", "m = 11 AND wd = 4 AND dd BETWEEN 22 AND 28"),
    ("ValentinesDay", "Cultural", "m = 2 AND dd = 14"),
    ("Mother's day", "Cultural", "m = 5 AND wd = 7 AND dd BETWEEN 8 AND 14"),
    ("SuperBowl", "Sporting", "m = 2 AND wd = 7 AND dd <= 7"),
    ("NBAFinalsEnd", "Sporting", "m = 6 AND wd = 7 AND dd BETWEEN 15 AND 21"),
    ("Purim End", "Religious", "m = 3 AND dd = 5"),
]
SECOND_EVENT_RULE = ("Father's day", "Cultural", "m = 6 AND wd = 7 AND dd BETWEEN 15 AND 21")

# Event names and types in sorted order, the columns of pivots.
EVENT_NAMES = sorted([r[0] for r in EVENT_RULES] + [SECOND_EVENT_RULE[0]])
EVENT_TYPES = ["Cultural", "National", "Religious", "Sporting"]

# Fixed rules: benefit days per state by day of month.
SNAP_RULES = {"CA": (1, 10), "TX": (3, 15), "WI": (2, 14)}


def calendar(spark: SparkSession, data_dir: str, daily: DataFrame | None = None) -> DataFrame:
    """One row per day of the ship-date range."""
    days = (
        ship_dates(spark, data_dir, daily)
        .agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
        .select("lo", F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date"))
        .withColumns(
            {
                "i": F.datediff("date", "lo"),
                "m": F.month("date"),
                "dd": F.dayofmonth("date"),
                "wd": F.weekday("date") + 1,
            }
        )
    )

    def pick(rules: list[tuple[str, str, str]], field: int) -> Column:
        chosen = F.lit(None).cast("string")
        for rule in reversed(rules):
            chosen = F.when(F.expr(rule[2]), F.lit(rule[field])).otherwise(chosen)
        return chosen

    return days.select(
        "date",
        F.concat(F.lit("d_"), (F.col("i") + 1).cast("string")).alias("d"),
        F.floor(F.col("i") / 7).cast("int").alias("wm_yr_wk"),
        F.date_format("date", "EEEE").alias("weekday"),
        (F.dayofweek("date") % 7 + 1).alias("wday"),
        pick(EVENT_RULES, 0).alias("event_name_1"),
        pick(EVENT_RULES, 1).alias("event_type_1"),
        pick([SECOND_EVENT_RULE], 0).alias("event_name_2"),
        pick([SECOND_EVENT_RULE], 1).alias("event_type_2"),
        *[
            F.col("dd").between(lo, hi).cast("int").alias(f"snap_{state}")
            for state, (lo, hi) in SNAP_RULES.items()
        ],
    )
