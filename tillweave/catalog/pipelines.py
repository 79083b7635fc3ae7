"""The user-level jobs: raw zone, interim zone, design matrix, panels, reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.catalog.features import (
    NEAR_SQL,
    TARGETS,
    WAVES_SQL,
    WEEKDAY_SQL,
    lead_lag_sql,
    rounded_fields,
    sql_name,
    sql_text,
)
from tillweave.catalog.registry import query
from tillweave.functions.maths import binomial_pmf
from tillweave.operators.panel import flag_out_of_stock, trim_before_first_sale
from tillweave.operators.relational import quoted, unnest_struct
from tillweave.plans import calendar_features as calendars
from tillweave.plans import design, events, interim, panels, raw, runner
from tillweave.session import scratch_folder
from tillweave.sources import zones
from tillweave.sources import sample_tables as tables
from tillweave.sources.sample_tables import EVENT_NAMES

# Fixed value: the threshold that marks runs at every scale of the sample tables.
SAMPLE_THRESHOLD = 0.001


def flagged_sales(spark, data_dir):
    return interim.sales_interim(tables.sales_long(spark, data_dir), SAMPLE_THRESHOLD)


def stored_calendar(spark, data_dir):
    """The calendar as a file, which it is in production: fits that read it often don't start from the order lines."""
    path = scratch_folder(spark, "calendar") + "/calendar"
    tables.calendar(spark, data_dir).write.parquet(path)
    return spark.read.parquet(path)


def regressors(spark, data_dir):
    calendar = stored_calendar(spark, data_dir)
    return design.regressor_table(
        calendars.snap_long(calendar),
        calendars.calendar_features(calendar),
        events.event_flags(calendar, EVENT_NAMES),
        events.event_window_memberships(calendar, EVENT_NAMES),
    )


@query("raw_sales_long", "SELECT id, date, CAST(sales AS SMALLINT) AS sales FROM sales_long")
def raw_sales_long(spark, data_dir):
    return raw.sales_raw(tables.sales_wide(spark, data_dir), tables.calendar(spark, data_dir))


@query("raw_prodloc", "SELECT * FROM prodloc")
def raw_prodloc(spark, data_dir):
    return raw.prodloc_raw(tables.sales_wide(spark, data_dir))


@query(
    "raw_price_daily",
    """SELECT p.id, c.date, s.sell_price FROM sell_prices s
       LEFT JOIN prodloc p ON s.item_id = p.item_id AND s.store_id = p.store_id
       LEFT JOIN calendar c ON s.wm_yr_wk = c.wm_yr_wk""",
)
def raw_price_daily(spark, data_dir):
    return raw.price_daily(
        tables.sell_prices(spark, data_dir), tables.prodloc(spark, data_dir), tables.calendar(spark, data_dir)
    )


@query("raw_calendar", "SELECT * FROM calendar")
def raw_calendar(spark, data_dir):
    return raw.calendar_raw(tables.calendar(spark, data_dir))


@query(
    "prodloc_lifecycle",
    """SELECT p.*, l.first_sales_date, l.last_sales_date, l.total_sales, CAST(hi - l.first_sales_date + 1 AS INTEGER) AS days_on_sale,
              l.first_sales_date AS range_start, hi AS range_end FROM prodloc p JOIN lifecycle l ON p.id = l.id, bounds""",
)
def prodloc_lifecycle(spark, data_dir):
    """The list of dates is shown by its length and ends."""
    made = interim.prodloc_lifecycle(tables.prodloc(spark, data_dir), tables.sales_long(spark, data_dir))
    days = F.col("prodloc_daterange")
    return made.withColumns(
        {
            "days_on_sale": F.size(days),
            "range_start": F.get(days, F.lit(0)),
            "range_end": F.try_element_at(days, F.lit(-1)),
        }
    ).drop("prodloc_daterange")


@query(
    "prodloc_lifecycle_full",
    """SELECT p.*, min(date) FILTER (WHERE sales > 0) AS first_tran_dt, max(date) FILTER (WHERE sales > 0) AS last_tran_dt,
              max(date) AS dataset_last_dt, CAST(sum(sales) AS BIGINT) AS total_unit_sales,
              CAST((SELECT hi FROM bounds) - min(date) FILTER (WHERE sales > 0) + 1 AS INTEGER) AS days_on_sale
       FROM prodloc p JOIN sales_long s ON p.id = s.id GROUP BY ALL""",
)
def prodloc_lifecycle_full(spark, data_dir):
    made = interim.prodloc_lifecycle_full(tables.prodloc(spark, data_dir), tables.sales_long(spark, data_dir))
    days = F.when(F.col("timeseries_daterange").isNotNull(), F.size("timeseries_daterange"))
    return made.withColumn("days_on_sale", days).drop("timeseries_daterange")


@query("trim_leading_zeros", "SELECT id, date, sales FROM sales_trim")
def trim_leading_zeros(spark, data_dir):
    return trim_before_first_sale(tables.sales_long(spark, data_dir))


@query("out_of_stock", "SELECT id, date, sales, zero_sales_ind, OOS FROM sales_oos")
def out_of_stock(spark, data_dir):
    return flagged_sales(spark, data_dir)


@query("out_of_stock_from_buckets", "SELECT id, date, sales, zero_sales_ind, OOS FROM sales_oos")
def out_of_stock_from_buckets(spark, data_dir):
    """The panel written once in buckets of product-locations; trimming and flags then read it without a shuffle."""
    root, buckets = scratch_folder(spark, "zones"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    zones.write_bucketed(tables.sales_long(spark, data_dir), ["id"], buckets, root, "2.raw", "sales_raw", sort_by=["id", "date"])
    return interim.sales_interim(zones.read_bucketed(spark, root, "2.raw", "sales_raw"), SAMPLE_THRESHOLD)


@query(
    "binomial_pmf",
    """SELECT id, CAST(n AS BIGINT) AS days, CAST(k AS BIGINT) AS zero_days,
              round(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p)), 8) AS pmf
       FROM (SELECT id, count(*) AS n, sum(CASE WHEN sales = 0 THEN 1 ELSE 0 END) AS k FROM sales_long GROUP BY id),
            (SELECT avg(CASE WHEN sales = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS p FROM sales_long)""",
)
def binomial_pmf_query(spark, data_dir):
    """Chance of each id's number of zero days at the overall share of them."""
    zero = F.when(F.col("sales") == 0, 1).otherwise(0)
    panel = tables.sales_long(spark, data_dir)
    overall = panel.agg(F.avg(zero.cast("double"))).scalar()
    counts = panel.groupBy("id").agg(F.count(F.lit(1)).alias("days"), F.sum(zero).alias("zero_days"))
    return counts.withColumn("p", overall).select(
        "id", "days", "zero_days", F.round(binomial_pmf(F.col("zero_days"), F.col("days"), F.col("p")), 8).alias("pmf")
    )


FLAG_SQL = ", ".join(
    f"CASE WHEN event_name_1 = {sql_text(n)} OR event_name_2 = {sql_text(n)} THEN 1 ELSE 0 END AS {sql_name(n)}"
    for n in EVENT_NAMES
)
SNAP_SQL = """SELECT date, 'CA' AS state_id, snap_CA AS snap_bool FROM calendar UNION ALL SELECT date, 'TX', snap_TX FROM calendar
       UNION ALL SELECT date, 'WI', snap_WI FROM calendar"""
# Memberships of a day add up to 1; those of an event's window do so on the days near it, and are 0 elsewhere.
MEMBERSHIP_SQL = ", ".join(
    ["1.0::DOUBLE AS trend_memberships", "1.0::DOUBLE AS wday_memberships"]
    + [
        f"CASE WHEN since_{i} <= 4 OR until_{i} <= 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {sql_name(n.lower() + '_window')}"
        for n in EVENT_NAMES
        for i in [TARGETS.index((n, "event_name"))]
    ]
)
REGRESSOR_SQL = f"""SELECT c.date, s.state_id, CAST(c.date - lo AS BIGINT) AS trend, s.snap_bool, {WEEKDAY_SQL}, {FLAG_SQL},
       {WAVES_SQL.replace('(date)', '(c.date)')}, {MEMBERSHIP_SQL}
       FROM calendar c JOIN snap_rows s ON c.date = s.date JOIN near_events n ON c.date = n.date, bounds"""
REGRESSOR_CTES = {"snap_rows": SNAP_SQL, "near_events": NEAR_SQL, "regressor_rows": REGRESSOR_SQL}


def plain_regressors(frame):
    """All ten feature columns, one column per feature; of the mixtures, the sums of their memberships."""
    fields = {c: frame.schema[c].dataType.fieldNames() for c in frame.columns if isinstance(frame.schema[c].dataType, T.StructType)}

    def total(struct, names, label):
        return F.round(sum((F.col(f"{struct}.{quoted(f)}") for f in names), F.lit(0.0)), 6).alias(label)

    near = "holiday_pre_post_guassian_splines"
    return [
        "trend",
        "snap_bool",
        "weekday_bool.*",
        "holiday_bool.*",
        *rounded_fields("year_month_trigonometric", fields["year_month_trigonometric"]),
        *[total(f"{c}_guassian_splines", fields[f"{c}_guassian_splines"], f"{c}_memberships") for c in ("trend", "wday")],
        *[total(near, [f for f in fields[near] if f.startswith(f"{n.lower()}_spline_")], f"{n.lower()}_window") for n in EVENT_NAMES],
    ]


def every_feature(frame):
    """All ten feature columns with their single fields."""
    structs = [c for c in design.REGRESSOR_COLUMNS if c in frame.columns and isinstance(frame.schema[c].dataType, T.StructType)]
    return ["trend", "snap_bool", *[f"{c}.*" for c in structs]]


@query("regressor_table", "SELECT * FROM regressor_rows", REGRESSOR_CTES)
def regressor_table(spark, data_dir):
    """All ten columns; single memberships are in ``regressor_table_mixture``."""
    table = regressors(spark, data_dir)
    return table.select("date", "state_id", *plain_regressors(table))


@query("regressor_table_mixture")
def regressor_table_mixture(spark, data_dir):
    """The mixture columns of the regressor table."""
    return regressors(spark, data_dir).select(
        "date",
        "state_id",
        "trend_guassian_splines.*",
        "wday_guassian_splines.*",
        "holiday_pre_post_guassian_splines.*",
    )


def written_regressors(spark, data_dir):
    """The regressor table as a data set: its size is known when facts meet it."""
    root = scratch_folder(spark, "regressors")
    zones.write_zone(regressors(spark, data_dir), root, "3.interim", "regressor_table")
    return zones.read_latest(spark, root, "3.interim", "regressor_table")


@query(
    "design_matrix",
    """SELECT o.*, p.* EXCLUDE (id, state_id), r.* EXCLUDE (date) FROM sales_oos o JOIN prodloc p ON o.id = p.id
       JOIN regressor_rows r ON o.date = r.date AND p.state_id = r.state_id""",
    REGRESSOR_CTES,
)
def design_matrix(spark, data_dir):
    matrix = design.design_matrix(
        flagged_sales(spark, data_dir), tables.prodloc(spark, data_dir), written_regressors(spark, data_dir)
    )
    facts = ["id", "date", "sales", "zero_sales_ind", "OOS", "item_id", "dept_id", "cat_id", "store_id", "state_id"]
    return matrix.select(*facts, *plain_regressors(matrix))


@query(
    "store_panel",
    """SELECT f.date, f.state_id, f.store_id, f.sales, f."OOS_COUNT", f."ProductPlaces", r.* EXCLUDE (date, state_id)
       FROM (SELECT o.date, p.state_id, p.store_id, CAST(sum(o.sales) AS BIGINT) AS sales, CAST(sum(o."OOS") AS BIGINT) AS "OOS_COUNT",
                    CAST(count(*) AS BIGINT) AS "ProductPlaces"
             FROM sales_oos o JOIN prodloc p ON o.id = p.id GROUP BY ALL) f
       JOIN regressor_rows r ON f.date = r.date AND f.state_id = r.state_id""",
    REGRESSOR_CTES,
)
def store_panel(spark, data_dir):
    panel = design.store_panel(
        flagged_sales(spark, data_dir), tables.prodloc(spark, data_dir), written_regressors(spark, data_dir)
    )
    facts = ["date", "state_id", "store_id", "sales", "OOS_COUNT", "ProductPlaces"]
    return panel.select(*facts, *plain_regressors(panel))


@query("design_matrix_features")
def design_matrix_features(spark, data_dir):
    """The design matrix with every field of all ten feature columns."""
    matrix = design.design_matrix(
        flagged_sales(spark, data_dir), tables.prodloc(spark, data_dir), written_regressors(spark, data_dir)
    )
    return matrix.select("id", "date", "sales", "zero_sales_ind", "OOS", "store_id", "state_id", *every_feature(matrix))


@query("store_panel_features")
def store_panel_features(spark, data_dir):
    """The store panel with every field of all ten feature columns."""
    panel = design.store_panel(
        flagged_sales(spark, data_dir), tables.prodloc(spark, data_dir), written_regressors(spark, data_dir)
    )
    return panel.select("date", "state_id", "store_id", "sales", "OOS_COUNT", "ProductPlaces", *every_feature(panel))


LEVELS = {
    "levels": """SELECT *, split_part(id, '_', 2) AS department, split_part(id, '_', 1) || '_' || split_part(id, '_', 2) AS category_dep,
                 split_part(id, '_', 4) || '_' || split_part(id, '_', 5) AS state_store FROM sales_oos"""
}


@query(
    "hierarchy_panel",
    """SELECT category_dep, state_store, date, CAST(sum(sales) AS BIGINT) AS sales, avg(sales) AS mean_sales, CAST(count(*) AS BIGINT) AS prodloc_count,
              CAST(sum(zero_sales_ind) AS BIGINT) AS zero_sales_ind, avg(zero_sales_ind) AS mean_zero_sales_ind,
              CAST(sum("OOS") AS BIGINT) AS "OOS", avg("OOS") AS "mean_OOS" FROM levels GROUP BY ALL""",
    LEVELS,
)
def hierarchy_panel(spark, data_dir):
    return panels.hierarchy_panel(flagged_sales(spark, data_dir))


OOS_REPORT_SQL = """SELECT department, category_dep, state_store,
        round(CAST(sum("OOS") AS DOUBLE) / nullif(sum(zero_sales_ind), 0) * 100, 6) AS pct_oos_of_zero_sale,
        round(CAST(sum("OOS") AS DOUBLE) / count(*) * 100, 6) AS pct_oos_of_total_sales,
        round(CAST(sum(zero_sales_ind) AS DOUBLE) / count(*) * 100, 6) AS pct_zero_of_total_sales,
        CAST(sum("OOS") AS BIGINT) AS oos_zero_sale, CAST(sum(zero_sales_ind) - sum("OOS") AS BIGINT) AS non_oss_zero_sale,
        CAST(sum(zero_sales_ind) AS BIGINT) AS zero_sales_ind, CAST(count(*) - sum(zero_sales_ind) AS BIGINT) AS sales_ind,
        CAST(count(*) AS BIGINT) AS count_possible_sale, round(avg(sales), 6) AS mean,
        round(avg(sales) FILTER (WHERE "OOS" = 0), 6) AS mean_excl_oos, median(sales) AS median,
        median(sales) FILTER (WHERE "OOS" = 0) AS median_excl_oos, round(log10(sum(sales)), 6) AS "log10Sum",
        round(var_samp(sales), 6) AS var, round(var_samp(sales) FILTER (WHERE "OOS" = 0), 6) AS var_excl_oos,
        round(stddev_samp(sales), 6) AS std, round(stddev_samp(sales) FILTER (WHERE "OOS" = 0), 6) AS std_excl_oos
       FROM levels GROUP BY department, category_dep, state_store"""


@query("oos_report", OOS_REPORT_SQL, LEVELS)
def oos_report(spark, data_dir):
    return panels.oos_report(flagged_sales(spark, data_dir), digits=6)


@query("wide_to_oos_report", OOS_REPORT_SQL, LEVELS)
def wide_to_oos_report(spark, data_dir):
    """The whole flow: wide file, long panel, trim, flags, report."""
    long = raw.sales_raw(tables.sales_wide(spark, data_dir), tables.calendar(spark, data_dir))
    return panels.oos_report(interim.sales_interim(long, SAMPLE_THRESHOLD), digits=6)


@query(
    "oos_share",
    'SELECT CAST(sum("OOS") AS DOUBLE) / nullif(sum(zero_sales_ind), 0) AS oos_share FROM sales_oos',
)
def oos_share(spark, data_dir):
    return panels.oos_share(flagged_sales(spark, data_dir))


@query(
    "assortment_size",
    """SELECT date, state_id, CAST(count(*) FILTER (WHERE sales > 0) AS BIGINT) AS "Nbr_unique_selling_prodlocs"
       FROM sales_trim JOIN prodloc USING (id) GROUP BY date, state_id""",
)
def assortment_size(spark, data_dir):
    trimmed = trim_before_first_sale(tables.sales_long(spark, data_dir))
    return panels.assortment_size(trimmed, tables.prodloc(spark, data_dir))


@query(
    "assortment_size_store",
    """SELECT *, split_part(store_id, '_', 1) AS state, split_part(store_id, '_', 2) AS store,
              CAST(row_number() OVER (PARTITION BY store_id ORDER BY date) - 1 AS INTEGER) AS trend
       FROM (SELECT date, store_id, state_id, CAST(count(*) FILTER (WHERE sales > 0) AS BIGINT) AS "Nbr_unique_selling_prodlocs"
             FROM sales_trim JOIN prodloc USING (id) GROUP BY date, store_id, state_id)""",
)
def assortment_size_store(spark, data_dir):
    trimmed = trim_before_first_sale(tables.sales_long(spark, data_dir))
    return panels.assortment_size_store(trimmed, tables.prodloc(spark, data_dir))


@query("sales_by_day", "SELECT date, CAST(sum(sales) AS BIGINT) AS total_sales FROM sales_long GROUP BY date")
def sales_by_day(spark, data_dir):
    return panels.sales_by_day(tables.sales_long(spark, data_dir))


@query(
    "sales_by_region",
    "SELECT state_id, date, CAST(sum(sales) AS BIGINT) AS sales FROM sales_long JOIN prodloc USING (id) GROUP BY state_id, date",
)
def sales_by_region(spark, data_dir):
    return panels.sales_by_region(tables.sales_long(spark, data_dir), tables.prodloc(spark, data_dir))


@query(
    "category_state_panel",
    f"""SELECT cat_id || '_' || state_id AS "Cat_state_id", s.date, s.sales, 1 AS constant,
               CAST(row_number() OVER (PARTITION BY cat_id, state_id ORDER BY s.date) AS BIGINT) AS trend, n.* EXCLUDE (date)
        FROM (SELECT date, cat_id, state_id, CAST(sum(sales) AS BIGINT) AS sales FROM sales_oos JOIN prodloc USING (id) GROUP BY ALL) s
        LEFT JOIN (SELECT date, {lead_lag_sql([(n, "event_name") for n in EVENT_NAMES])} FROM near_events) n ON s.date = n.date""",
    {"near_events": NEAR_SQL},
)
def category_state_panel(spark, data_dir):
    features = events.event_lead_lag(tables.calendar(spark, data_dir), EVENT_NAMES)
    panel = panels.category_state_panel(
        flagged_sales(spark, data_dir), tables.prodloc(spark, data_dir), features
    )
    return unnest_struct(panel, *EVENT_NAMES)


def built_zones(spark, data_dir):
    daily = tables.daily_lines(spark, data_dir)
    inputs = runner.Inputs(
        sales_long=tables.sales_long(spark, data_dir, daily),
        prodloc=tables.prodloc(spark, data_dir, daily),
        calendar=tables.calendar(spark, data_dir, daily),
        prices=tables.sell_prices(spark, data_dir, daily),
        event_names=EVENT_NAMES,
    )
    root = scratch_folder(spark, "zones")
    return root, runner.build_all(spark, root, inputs, SAMPLE_THRESHOLD)


BUILT_SQL = " UNION ALL ".join(
    f"SELECT '{zone}' AS zone, '{name}' AS data_set, CAST(count(*) AS BIGINT) AS rows FROM {rows}"
    for zone, name, rows in [
        ("2.raw", "prodloc_raw", "prodloc"),
        ("2.raw", "sales_raw", "sales_long"),
        ("2.raw", "calendar_raw", "calendar"),
        ("2.raw", "price_raw", "sell_prices s LEFT JOIN calendar c USING (wm_yr_wk)"),
        ("3.interim", "prodlocs", "prodloc"),
        ("3.interim", "sales", "sales_oos"),
        ("3.interim", "calendar_event_bool_features", "calendar"),
        ("3.interim", "event_post_effect_features", "(SELECT DISTINCT event_type, event_name, date + n AS day FROM event_days, (SELECT CAST(unnest(generate_series(1, 7)) AS INTEGER) AS n))"),
        ("3.interim", "snap_features", "snap_rows"),
        ("3.interim", "calender_features", "calendar"),
        ("3.interim", "calendar_event_gmm_features", "calendar"),
        ("3.interim", "regressor_table", "snap_rows"),
        ("4.processed", "designmatrix", "sales_oos"),
    ]
)


@query("build_interim", BUILT_SQL, {"snap_rows": SNAP_SQL})
def build_interim(spark, data_dir):
    """Write every raw, interim and processed data set; list what was written."""
    root, written = built_zones(spark, data_dir)
    return runner.row_counts(spark, root, written)


@query("build_backtest")
def build_backtest(spark, data_dir):
    """All zones, then the back-test of the written design matrix; its error metrics per split."""
    root, _ = built_zones(spark, data_dir)
    runner.build_backtest(spark, root)
    return zones.read_latest(spark, root, "4.processed", "backtest_metrics")
