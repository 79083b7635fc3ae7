"""Projection, filters, null handling and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillweave.catalog.registry import query
from tillweave.functions import dates, maths, text
from tillweave.operators import nulls, quantiles, relational, reshape
from tillweave.sources import sample_tables as tables
from tillweave.sources.sample_tables import table


@query("select_columns", "SELECT p_partkey, p_brand, p_size FROM part")
def select_columns(spark, data_dir):
    return table(spark, data_dir, "part").transform(
        relational.select_columns, ["p_partkey", "p_brand", "p_size"]
    )


@query("drop_columns", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def drop_columns(spark, data_dir):
    return table(spark, data_dir, "customer").drop("c_acctbal")


@query("rename", "SELECT s_suppkey AS supplier_id, s_name AS supplier, s_nationkey, s_acctbal FROM supplier")
def rename(spark, data_dir):
    return table(spark, data_dir, "supplier").transform(
        reshape.rename_columns, {"s_suppkey": "supplier_id", "s_name": "supplier"}
    )


@query("select_except", "SELECT * EXCLUDE (o_totalprice, o_orderdate) FROM orders")
def select_except(spark, data_dir):
    return table(spark, data_dir, "orders").transform(
        relational.select_except, ["o_totalprice", "o_orderdate"]
    )


@query(
    "with_columns",
    """SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS weighted_price,
              l_discount + l_tax AS rates, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem""",
)
def with_columns(spark, data_dir):
    return (
        table(spark, data_dir, "lineitem")
        .withColumns(
            {
                "weighted_price": F.col("l_quantity") * F.col("l_extendedprice"),
                "rates": F.col("l_discount") + F.col("l_tax"),
                "l_shipdate": F.col("l_shipdate").cast("date"),
            }
        )
        .select("l_orderkey", "l_linenumber", "weighted_price", "rates", "l_shipdate")
    )


@query(
    "literal_columns",
    """SELECT o_orderkey, CAST(1 AS INTEGER) AS constant, 'train' AS set_type, DATE '2001-01-01' AS set_first_date
       FROM orders""",
)
def literal_columns(spark, data_dir):
    return table(spark, data_dir, "orders").select(
        "o_orderkey",
        F.lit(1).alias("constant"),
        F.lit("train").alias("set_type"),
        F.lit("2001-01-01").cast("date").alias("set_first_date"),
    )


@query(
    "cast_types",
    """SELECT l_orderkey, CAST(l_quantity AS SMALLINT) AS quantity_short, CAST(l_linenumber AS BIGINT) AS line_long,
              CAST(l_partkey AS VARCHAR) AS part_text, CAST(l_shipdate AS DATE) AS ship_day FROM lineitem""",
)
def cast_types(spark, data_dir):
    """Strict casts: a value that does not fit raises."""
    return table(spark, data_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_quantity").cast("smallint").alias("quantity_short"),
        F.col("l_linenumber").cast("bigint").alias("line_long"),
        F.col("l_partkey").cast("string").alias("part_text"),
        F.col("l_shipdate").cast("date").alias("ship_day"),
    )


@query("apply_transform", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 500.0")
def apply_transform(spark, data_dir):
    def keep_rich(df, at_least):
        return df.where(F.col("c_acctbal") >= at_least).select("c_custkey", "c_acctbal")

    return relational.apply_transform(table(spark, data_dir, "customer"), keep_rich, at_least=500.0)


@query("pack_struct", "SELECT p_partkey, p_size AS size, p_retailprice AS price FROM part")
def pack_struct(spark, data_dir):
    """Read back field by field, as struct values compare differently per engine."""
    packed = table(spark, data_dir, "part").transform(
        relational.pack_struct, ["p_size", "p_retailprice"], "measures", drop=True
    )
    return packed.select(
        "p_partkey", F.col("measures.p_size").alias("size"), F.col("measures.p_retailprice").alias("price")
    )


@query("unnest_struct", "SELECT p_partkey, p_size, p_retailprice FROM part")
def unnest_struct(spark, data_dir):
    packed = table(spark, data_dir, "part").select(
        "p_partkey", F.struct("p_size", "p_retailprice").alias("measures")
    )
    return packed.transform(relational.unnest_struct, "measures")


@query(
    "struct_fields",
    "SELECT l_orderkey, l_linenumber, l_discount + l_tax + l_quantity AS total FROM lineitem",
)
def struct_fields(spark, data_dir):
    """Sum over the fields that the struct's schema names; no job for the schema."""
    packed = table(spark, data_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.struct("l_discount", "l_tax", "l_quantity").alias("measures")
    )
    fields = relational.struct_fields(packed, "measures")
    return packed.select(
        "l_orderkey", "l_linenumber", maths.row_sum(F.col(f"measures.{f}") for f in fields).alias("total")
    )


@query(
    "conditional",
    """SELECT id, date, CASE WHEN sales = 0 THEN 'none' WHEN sales < 50 THEN 'some' ELSE 'many' END AS level
       FROM sales_long""",
)
def conditional(spark, data_dir):
    sales = F.col("sales")
    level = F.when(sales == 0, "none").when(sales < 50, "some").otherwise("many")
    return tables.sales_long(spark, data_dir).select("id", "date", level.alias("level"))


# Labels of the return flags.
FLAG_LABELS = {"R": "returned", "A": "accepted", "N": "none"}


@query(
    "lookup_strict",
    """SELECT l_orderkey, l_linenumber,
              CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'none' END AS flag_label,
              CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'other' END AS status_label
       FROM lineitem""",
)
def lookup_strict(spark, data_dir):
    return table(spark, data_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        relational.lookup_strict("l_returnflag", FLAG_LABELS).alias("flag_label"),
        relational.lookup_strict("l_linestatus", {"O": "open"}, default="other", strict=False).alias("status_label"),
    )


@query("hash_column", "SELECT *, CAST('0x' || substr(md5('4:' || id), 1, 15) AS BIGINT) AS id_seq_num FROM prodloc")
def hash_column(spark, data_dir):
    return tables.prodloc(spark, data_dir).transform(relational.hash_column, "id", "id_seq_num")


@query(
    "filter_compare",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
       WHERE l_quantity > 10 AND l_discount >= 0.05 AND l_tax < 0.06 AND l_returnflag = 'R'""",
)
def filter_compare(spark, data_dir):
    return (
        table(spark, data_dir, "lineitem")
        .where(F.col("l_quantity") > 10)
        .where(F.col("l_discount") >= 0.05)
        .where(F.col("l_tax") < 0.06)
        .where(F.col("l_returnflag") == "R")
        .select("l_orderkey", "l_linenumber", "l_quantity")
    )


@query(
    "filter_in",
    """SELECT o_orderkey, o_orderpriority FROM orders
       WHERE o_orderstatus IN ('O', 'F') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def filter_in(spark, data_dir):
    """Literals as a list, values of another table as a semi join."""
    wanted = table(spark, data_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return (
        table(spark, data_dir, "orders")
        .where(F.col("o_orderstatus").isin("O", "F"))
        .join(wanted, "o_custkey", "left_semi")
        .select("o_orderkey", "o_orderpriority")
    )


@query(
    "filter_between",
    """SELECT l_orderkey, l_linenumber FROM lineitem
       WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""",
)
def filter_between(spark, data_dir):
    """Compared as timestamps, so that the scan gets the filter."""
    day = F.col("l_shipdate")
    lo, hi = F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1999-01-01").cast("timestamp_ntz")
    return table(spark, data_dir, "lineitem").where((day >= lo) & (day < hi)).select("l_orderkey", "l_linenumber")


@query(
    "filter_bool",
    """SELECT l_orderkey, l_linenumber FROM lineitem
       WHERE (l_quantity <= 5 OR l_quantity >= 45) AND NOT (l_linestatus = 'O' AND l_tax = 0)""",
)
def filter_bool(spark, data_dir):
    quantity = F.col("l_quantity")
    return (
        table(spark, data_dir, "lineitem")
        .where(((quantity <= 5) | (quantity >= 45)) & ~((F.col("l_linestatus") == "O") & (F.col("l_tax") == 0)))
        .select("l_orderkey", "l_linenumber")
    )


@query(
    "filter_not_null",
    """SELECT l.l_orderkey, l.l_linenumber, c.event_name_1 FROM lineitem l
       JOIN calendar c ON CAST(l.l_shipdate AS DATE) = c.date WHERE c.event_name_1 IS NOT NULL""",
)
def filter_not_null(spark, data_dir):
    events = tables.calendar(spark, data_dir).select("date", "event_name_1").where(F.col("event_name_1").isNotNull())
    return (
        table(spark, data_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("date"))
        .join(events, "date")
        .drop("date")
    )


@query(
    "drop_nulls",
    """SELECT o.o_orderkey, c.event_name_1, c.event_type_1 FROM orders o
       LEFT JOIN calendar c ON CAST(o.o_orderdate AS DATE) = c.date
       WHERE c.event_name_1 IS NOT NULL AND c.event_type_1 IS NOT NULL""",
)
def drop_nulls(spark, data_dir):
    events = tables.calendar(spark, data_dir).select("date", "event_name_1", "event_type_1")
    return (
        table(spark, data_dir, "orders")
        .select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
        .join(events, "date", "left")
        .drop("date")
        .transform(nulls.drop_nulls)
    )


@query(
    "fill_zero",
    """SELECT c_custkey, CAST(coalesce(count(event_id), 0) AS BIGINT) AS events, coalesce(round(sum(value), 4), 0) AS value
       FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey""",
)
def fill_zero(spark, data_dir):
    events = (
        table(spark, data_dir, "events")
        .groupBy(F.col("user_id").alias("c_custkey"))
        .agg(F.count("event_id").alias("events"), F.round(F.sum("value"), 4).alias("value"))
    )
    joined = table(spark, data_dir, "customer").select("c_custkey").join(events, "c_custkey", "left")
    return joined.transform(nulls.fill_zero, ["events", "value"])


@query(
    "fill_backward",
    """SELECT id, date, first_value(CASE WHEN sales > 0 THEN sales END IGNORE NULLS) OVER
              (PARTITION BY id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_sales
       FROM sales_long""",
)
def fill_backward(spark, data_dir):
    sold = F.when(F.col("sales") > 0, F.col("sales"))
    return tables.sales_long(spark, data_dir).select(
        "id", "date", nulls.fill_backward(sold, "id", "date").alias("next_sales")
    )


@query(
    "quantile_tails",
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem,
              (SELECT quantile_disc(l_extendedprice, 0.01) AS lo, quantile_disc(l_extendedprice, 0.99) AS hi FROM lineitem)
       WHERE l_extendedprice <= lo OR l_extendedprice >= hi""",
)
def quantile_tails(spark, data_dir):
    return (
        table(spark, data_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_extendedprice")
        .transform(quantiles.quantile_tails, "l_extendedprice", 0.01, 0.99)
    )


@query(
    "date_parts",
    """SELECT l_orderkey, l_linenumber, CAST(day(l_shipdate) AS INTEGER) AS day_of_month,
              CAST(dayofyear(l_shipdate) AS INTEGER) AS day_of_year, CAST(month(l_shipdate) AS INTEGER) AS month,
              CAST(isodow(l_shipdate) AS INTEGER) AS weekday FROM lineitem""",
)
def date_parts(spark, data_dir):
    day = F.col("l_shipdate").cast("date")
    return table(spark, data_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.dayofmonth(day).alias("day_of_month"),
        F.dayofyear(day).alias("day_of_year"),
        F.month(day).alias("month"),
        dates.iso_weekday(day).alias("weekday"),
    )


@query(
    "date_shift",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) - 13 AS before_13, CAST(o_orderdate AS DATE) + 4 AS after_4 FROM orders""",
)
def date_shift(spark, data_dir):
    day = F.col("o_orderdate").cast("date")
    return table(spark, data_dir, "orders").select(
        "o_orderkey", F.date_sub(day, 13).alias("before_13"), F.date_add(day, 4).alias("after_4")
    )


@query(
    "date_ranges",
    """SELECT l_orderkey, l_linenumber, CAST(greatest(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) + 1, 0) AS INTEGER) AS days,
              CASE WHEN l_shipdate >= o_orderdate THEN CAST(o_orderdate AS DATE) END AS first_day,
              CASE WHEN l_shipdate >= o_orderdate THEN CAST(l_shipdate AS DATE) END AS last_day
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def date_ranges(spark, data_dir):
    """Days between order and shipment as a list; empty if shipped before ordered."""
    placed = table(spark, data_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("placed")
    )
    span = dates.date_span(F.col("placed"), F.col("l_shipdate").cast("date"))
    return (
        table(spark, data_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_shipdate")
        .join(placed, "l_orderkey")
        .withColumn("span", span)
        .select(
            "l_orderkey",
            "l_linenumber",
            F.size("span").alias("days"),
            F.get("span", F.lit(0)).alias("first_day"),
            F.try_element_at("span", F.lit(-1)).alias("last_day"),
        )
    )


@query(
    "str_case_concat",
    """SELECT p_partkey, lower(p_type) AS low, upper(p_name) AS high, p_brand || '_' || p_type AS joined,
              'EVENT_' || upper(p_type) || '_' || upper(p_name) AS feature FROM part""",
)
def str_case_concat(spark, data_dir):
    return table(spark, data_dir, "part").select(
        "p_partkey",
        F.lower("p_type").alias("low"),
        F.upper("p_name").alias("high"),
        text.join_text(F.col("p_brand"), "_", F.col("p_type")).alias("joined"),
        text.join_text(F.upper(F.lit("event")), "_", F.upper("p_type"), "_", F.upper("p_name")).alias("feature"),
    )


@query(
    "str_replace_prefix",
    "SELECT p_partkey, regexp_replace(p_brand, '^Brand#', '') AS brand FROM part",
)
def str_replace_prefix(spark, data_dir):
    return table(spark, data_dir, "part").select("p_partkey", text.strip_prefix(F.col("p_brand"), "Brand#").alias("brand"))


@query(
    "str_split_get",
    """SELECT id, split_part(id, '_', 1) || '_' || split_part(id, '_', 2) AS category_dep,
              split_part(id, '_', 4) || '_' || split_part(id, '_', 5) AS state_store,
              split_part(id, '_', 2) AS department FROM prodloc""",
)
def str_split_get(spark, data_dir):
    key = F.col("id")
    return tables.prodloc(spark, data_dir).select(
        "id",
        text.take_parts(key, [0, 1]).alias("category_dep"),
        text.take_parts(key, [3, 4]).alias("state_store"),
        text.take_parts(key, [1]).alias("department"),
    )


@query(
    "math_trig",
    """SELECT l_orderkey, l_linenumber,
              round(sin(2 * pi() * (dayofyear(l_shipdate) % 365.25::DOUBLE) / 365.25::DOUBLE), 6) AS year_sin,
              round(cos(4 * pi() * day(l_shipdate) / 30.5::DOUBLE), 6) AS month_cos FROM lineitem""",
)
def math_trig(spark, data_dir):
    day = F.col("l_shipdate").cast("date")
    year_position = F.dayofyear(day).cast("double") % F.lit(365.25)
    return table(spark, data_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(F.sin(maths.harmonic_angle(year_position, 365.25, 1)), 6).alias("year_sin"),
        F.round(F.cos(maths.harmonic_angle(F.dayofmonth(day), 30.5, 2)), 6).alias("month_cos"),
    )


@query(
    "math_basic",
    """SELECT l_orderkey, l_linenumber, pow(l_quantity, 2) AS squared, sqrt(l_quantity) AS root,
              round(exp(l_discount), 6) AS grown, round(ln(l_quantity), 6) AS ln_quantity,
              round(log10(l_extendedprice), 6) AS log10_price, abs(l_discount - l_tax) AS gap,
              CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity / l_tax END AS ratio FROM lineitem""",
)
def math_basic(spark, data_dir):
    quantity = F.col("l_quantity")
    return table(spark, data_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.pow(quantity, F.lit(2)).alias("squared"),
        F.sqrt(quantity).alias("root"),
        F.round(F.exp("l_discount"), 6).alias("grown"),
        F.round(maths.safe_log(quantity), 6).alias("ln_quantity"),
        F.round(maths.safe_log10(F.col("l_extendedprice")), 6).alias("log10_price"),
        F.abs(F.col("l_discount") - F.col("l_tax")).alias("gap"),
        maths.safe_divide(quantity, F.col("l_tax")).alias("ratio"),
    )


@query(
    "sum_horizontal",
    """SELECT date, coalesce(snap_CA, 0) + coalesce(snap_TX, 0) + coalesce(snap_WI, 0) AS snap_states,
              CAST(coalesce(sum(s.sales), 0) AS BIGINT) AS sales
       FROM calendar JOIN sales_long s USING (date) GROUP BY ALL""",
)
def sum_horizontal(spark, data_dir):
    flags = tables.calendar(spark, data_dir).select(
        "date", maths.row_sum([F.col("snap_CA"), F.col("snap_TX"), F.col("snap_WI")]).alias("snap_states")
    )
    daily = tables.sales_long(spark, data_dir).groupBy("date").agg(F.sum("sales").alias("sales"))
    return flags.join(daily, "date")


@query(
    "array_build",
    """SELECT o_orderkey, CAST(n AS BIGINT) AS steps, CAST(n * (n + 1) // 2 AS BIGINT) AS step_total, 1 AS first_step
       FROM (SELECT o_orderkey, CAST(floor(ln(o_totalprice + 3)) AS BIGINT) AS n FROM orders)""",
)
def array_build(spark, data_dir):
    """A list 1..n per row and a list of two columns, read back by their sums."""
    steps = F.floor(F.log(F.col("o_totalprice") + 3))
    return (
        table(spark, data_dir, "orders")
        .select("o_orderkey", F.when(steps >= 1, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<bigint>")).alias("ladder"))
        .select(
            "o_orderkey",
            F.get(F.array(F.size("ladder").cast("long"), F.lit(0).cast("long")), F.lit(0)).alias("steps"),
            F.aggregate("ladder", F.lit(0).cast("long"), lambda a, x: a + x).alias("step_total"),
            F.get("ladder", F.lit(0)).cast("int").alias("first_step"),
        )
    )


@query(
    "udf_scalar",
    """SELECT id, CAST((SELECT hi FROM bounds) - first_sales_date + 1 AS INTEGER) AS days,
              round(exp(lgamma(31) - lgamma(11) - lgamma(21) + 10 * ln(p) + 20 * ln(1 - p)), 9) AS pmf
       FROM lifecycle JOIN (SELECT id, avg(CASE WHEN sales = 0 THEN 1.0 ELSE 0.0 END) AS p FROM sales_long GROUP BY id) USING (id)""",
)
def udf_scalar(spark, data_dir):
    """Per-value Python functions as built-in expressions: a date list and a
    binomial probability (10 zero days out of 30)."""
    panel = tables.sales_long(spark, data_dir)
    _, last_day = tables.date_bounds(spark, data_dir)
    sold = F.col("sales") > 0
    return (
        panel.groupBy("id")
        .agg(
            F.min(F.when(sold, F.col("date"))).alias("first"),
            F.avg(F.when(sold, 0.0).otherwise(1.0)).alias("p"),
        )
        .where(F.col("first").isNotNull())
        .select(
            "id",
            F.size(dates.date_span(F.col("first"), last_day)).alias("days"),
            F.round(maths.binomial_pmf(F.lit(10), F.lit(30), F.col("p")), 9).alias("pmf"),
        )
    )


# A share whose levels are no short decimals, so that no rounding is a tie.
SMOOTHING = 1 / 7


@query(
    "udf_table",
    f"""SELECT id, date, round(power({1 - SMOOTHING}::DOUBLE, t) * sum(CASE WHEN t = 0 THEN sales ELSE {SMOOTHING}::DOUBLE * sales END * power({1 - SMOOTHING}::DOUBLE, -t))
               OVER (PARTITION BY id ORDER BY date), 6) AS level
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date) - 1 AS t FROM sales_long)""",
)
def udf_table(spark, data_dir):
    """A user function per series, on Arrow batches of one series at a time: a level that each day moves on from the
    day before, which no frame of rows gives."""

    def smooth(pdf):
        pdf = pdf.sort_values("date")
        return pdf.assign(level=pdf["sales"].ewm(alpha=SMOOTHING, adjust=False).mean().round(6))[["id", "date", "level"]]

    panel = tables.sales_long(spark, data_dir)
    return panel.groupBy("id").applyInPandas(smooth, "id string, date date, level double")
