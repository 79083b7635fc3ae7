"""Calendar, event and benefit-day features; mixture memberships."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillweave.catalog.registry import query
from tillweave.operators.mixture import em_rounds, fit_mixtures, mixture_memberships
from tillweave.operators.relational import quoted, unnest_struct
from tillweave.plans import calendar_features as calendars
from tillweave.plans import events
from tillweave.schemas import WEEKDAYS
from tillweave.sources import sample_tables as tables
from tillweave.sources.sample_tables import EVENT_NAMES, EVENT_RULES, EVENT_TYPES, SECOND_EVENT_RULE, table


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_name(value: str) -> str:
    return '"' + value + '"'


# Event labels of the post-event features, in sorted order.
EVENT_LABELS = sorted(events.event_label(r[1], r[0]) for r in [*EVENT_RULES, SECOND_EVENT_RULE])

WAVES_SQL = ", ".join(
    f"round({wave}(2 * pi() * {k} * ({position}) / {period}::DOUBLE), 6) AS {prefix}{wave}_{k}"
    for prefix, position, period in (
        ("", "CAST(dayofyear(date) AS DOUBLE) % 365.25::DOUBLE", "365.25"),
        ("month_", "CAST(day(date) AS DOUBLE)", "30.5"),
    )
    for wave in ("sin", "cos")
    for k in (1, 2, 3)
)
WEEKDAY_SQL = ", ".join(
    f"CASE WHEN weekday = '{d.capitalize()}' THEN 1 ELSE 0 END AS {d}" for d in WEEKDAYS
)


def rounded_fields(struct: str, fields, digits: int = 6):
    return [F.round(F.col(f"{struct}.{quoted(f)}"), digits).alias(f) for f in fields]


@query(
    "calendar_fourier",
    f"""SELECT date, d, wm_yr_wk, weekday, wday, CAST(day(date) AS INTEGER) AS day_of_month,
               CAST(dayofyear(date) AS INTEGER) AS day_of_year, {WAVES_SQL} FROM calendar""",
)
def calendar_fourier(spark, data_dir):
    made = calendars.calendar_fourier(tables.calendar(spark, data_dir))
    fields = made.schema["year_month_trigonometric"].dataType.fieldNames()
    return made.select(
        "date", "d", "wm_yr_wk", "weekday", "wday", "day_of_month", "day_of_year",
        *rounded_fields("year_month_trigonometric", fields),
    )


@query("weekday_onehot", f"SELECT date, {WEEKDAY_SQL} FROM calendar")
def weekday_onehot(spark, data_dir):
    """From the weekday name; packed and read back."""
    flagged = calendars.weekday_flags(tables.calendar(spark, data_dir))
    return flagged.select("date", "weekday_bool.*")


@query(
    "weekday_onehot_dates",
    "SELECT o_orderkey, "
    + ", ".join(f"CAST(isodow(o_orderdate) = {i} AS INTEGER) AS {d}" for i, d in enumerate(WEEKDAYS, 1))
    + " FROM orders",
)
def weekday_onehot_dates(spark, data_dir):
    """From the date of each order."""
    days = table(spark, data_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return calendars.weekday_one_hot(days).drop("date")


@query("gmm_membership")
def gmm_membership(spark, data_dir):
    """Weekday and trend memberships of every calendar day."""
    return (
        tables.calendar(spark, data_dir)
        .select("date", "wday")
        .transform(calendars.day_trend)
        .transform(mixture_memberships, "wday", calendars.WEEKDAY_COMPONENTS)
        .transform(mixture_memberships, "trend", calendars.TREND_COMPONENTS)
        .transform(unnest_struct, "wday_guassian_splines", "trend_guassian_splines")
    )


@query(
    "gmm_one_component",
    """SELECT o_orderstatus, 1.0::DOUBLE AS weight, round(avg(o_totalprice), 4) AS mean, round(var_pop(o_totalprice) + 1e-6, 2) AS variance
       FROM orders GROUP BY o_orderstatus""",
)
def gmm_one_component(spark, data_dir):
    """A mixture of one component is mean and variance."""
    fitted = fit_mixtures(table(spark, data_dir, "orders"), "o_totalprice", 1, ["o_orderstatus"])
    return fitted.select(
        "o_orderstatus",
        F.round(F.col("weights")[0], 9).alias("weight"),
        F.round(F.col("means")[0], 4).alias("mean"),
        F.round(F.col("variances")[0], 2).alias("variance"),
    )


# Starts and rounds of the checked mixtures.
EM_STARTS = {
    2: ([0.5, 0.5], [15.0, 35.0], [40.0, 60.0]),
    3: ([0.3, 0.4, 0.3], [10.0, 25.0, 42.0], [30.0, 50.0, 20.0]),
}
EM_ROUNDS = 5


def em_sql(k: int) -> str:
    """EM rounds as unrolled common table expressions."""
    js = range(1, k + 1)
    literal = ", ".join(f"{v}::DOUBLE AS {c}{j}" for c, part in zip("wmv", EM_STARTS[k]) for j, v in enumerate(part, 1))
    steps = [f"p0 AS (SELECT DISTINCT g, {literal} FROM h)"]
    for i in range(EM_ROUNDS):
        logs = ", ".join(f"ln(w{j}) - 0.5 * ln(2 * pi() * v{j}) - (x - m{j}) * (x - m{j}) / (2 * v{j}) AS l{j}" for j in js)
        total = " + ".join(f"exp(l{j} - top)" for j in js)
        shares = ", ".join(f"exp(l{j} - top) / ({total}) AS r{j}" for j in js)
        new = ", ".join(
            f"sum(n * r{j}) / sum(n) AS w{j}, sum(n * r{j} * x) / sum(n * r{j}) AS m{j}, "
            f"sum(n * r{j} * x * x) / sum(n * r{j}) - power(sum(n * r{j} * x) / sum(n * r{j}), 2) + 1e-6 AS v{j}"
            for j in js
        )
        steps += [
            f"l{i} AS (SELECT g, x, n, {logs} FROM h JOIN p{i} USING (g))",
            f"r{i} AS (SELECT g, x, n, {shares} FROM (SELECT *, greatest({', '.join(f'l{j}' for j in js)}) AS top FROM l{i}))",
            f"p{i + 1} AS MATERIALIZED (SELECT g, {new} FROM r{i} GROUP BY g)",
        ]
    columns = ", ".join(f"round({c}{j}, 6) AS {name}_{j}" for c, name in (("w", "weight"), ("m", "mean"), ("v", "variance")) for j in js)
    return f"""WITH h AS (SELECT l_returnflag AS g, l_quantity AS x, count(*) AS n FROM lineitem GROUP BY ALL), {', '.join(steps)}
        SELECT g AS l_returnflag, {columns} FROM p{EM_ROUNDS}"""


def em_parameters(spark, data_dir, k):
    fitted = em_rounds(table(spark, data_dir, "lineitem"), "l_quantity", ["l_returnflag"], EM_STARTS[k], EM_ROUNDS)
    parts = [("weights", "weight"), ("means", "mean"), ("variances", "variance")]
    return fitted.select(
        "l_returnflag", *[F.round(F.col(c)[j], 6).alias(f"{name}_{j + 1}") for c, name in parts for j in range(k)]
    )


@query("gmm_two_components", em_sql(2))
def gmm_two_components(spark, data_dir):
    """Parameters of a mixture after a few rounds from fixed starts, per group."""
    return em_parameters(spark, data_dir, 2)


@query("gmm_three_components", em_sql(3))
def gmm_three_components(spark, data_dir):
    return em_parameters(spark, data_dir, 3)


@query("gmm_cluster")
def gmm_cluster(spark, data_dir):
    """Line quantities grouped into three sizes, with the share of each."""
    lines = table(spark, data_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return lines.transform(mixture_memberships, "l_quantity", 3, cluster=True).transform(
        unnest_struct, "l_quantity_guassian_splines"
    )


@query(
    "event_flags",
    "SELECT date, "
    + ", ".join(
        f"CASE WHEN event_name_1 = {sql_text(n)} OR event_name_2 = {sql_text(n)} THEN 1 ELSE 0 END AS {sql_name(n)}"
        for n in EVENT_NAMES
    )
    + " FROM calendar",
)
def event_flags(spark, data_dir):
    return events.event_flags(tables.calendar(spark, data_dir), EVENT_NAMES).select("date", "holiday_bool.*")


@query(
    "event_window_positions",
    """SELECT lower(event_name) AS event, date AS event_date, CAST(date + k AS DATE) AS date, CAST(k + 4 AS INTEGER) AS spline
       FROM event_days CROSS JOIN (SELECT CAST(unnest(generate_series(-4, 4)) AS INTEGER) AS k)""",
)
def event_window_positions(spark, data_dir):
    return events.event_positions(tables.calendar(spark, data_dir))


@query("event_window_gmm")
def event_window_gmm(spark, data_dir):
    return events.event_window_memberships(tables.calendar(spark, data_dir), EVENT_NAMES).select(
        "date", "holiday_pre_post_guassian_splines.*"
    )


@query(
    "event_post_effects",
    "SELECT range, event, "
    + ", ".join(
        f"CAST(count(*) FILTER (WHERE event = {sql_text(label)} AND n = {n}) AS BIGINT) AS {sql_name(f'{label}_{n}')}"
        for label in EVENT_LABELS
        for n in range(1, 8)
    )
    + """ FROM (SELECT CAST(date + n AS DATE) AS range, 'EVENT_' || upper(event_type) || '_' || upper(event_name) AS event, n
               FROM event_days CROSS JOIN (SELECT CAST(unnest(generate_series(1, 7)) AS INTEGER) AS n)) GROUP BY range, event""",
)
def event_post_effects(spark, data_dir):
    return events.event_post_effects(tables.calendar(spark, data_dir), EVENT_LABELS)


TARGETS = [(t, "event_type") for t in EVENT_TYPES] + [(n, "event_name") for n in EVENT_NAMES]
NEAR_SQL = (
    "SELECT c.date, "
    + ", ".join(
        f"min(CASE WHEN e.{column} = {sql_text(value)} AND c.date >= e.date THEN c.date - e.date END) AS since_{i}, "
        f"min(CASE WHEN e.{column} = {sql_text(value)} AND c.date <= e.date THEN e.date - c.date END) AS until_{i}"
        for i, (value, column) in enumerate(TARGETS)
    )
    + " FROM calendar c LEFT JOIN event_days e ON e.date BETWEEN c.date - 20 AND c.date + 20 GROUP BY c.date"
)


def lead_lag_sql(targets) -> str:
    return ", ".join(
        f"CASE WHEN {side}_{TARGETS.index(target)} <= {h} THEN 1 ELSE 0 END AS {sql_name(f'{target[0]}_{sign}{h}d')}"
        for target in targets
        for side, sign in (("since", ""), ("until", "-"))
        for h in events.HORIZONS
    )


@query("event_lead_lag", f"SELECT date, {lead_lag_sql(TARGETS)} FROM near_events", {"near_events": NEAR_SQL})
def event_lead_lag(spark, data_dir):
    made = events.event_lead_lag(tables.calendar(spark, data_dir), EVENT_NAMES, EVENT_TYPES)
    return unnest_struct(made, *[c for c in made.columns if c != "date"])


@query(
    "snap_long",
    """SELECT date, 'CA' AS state, snap_CA AS snap_bool FROM calendar UNION ALL SELECT date, 'TX', snap_TX FROM calendar
       UNION ALL SELECT date, 'WI', snap_WI FROM calendar""",
)
def snap_long(spark, data_dir):
    return calendars.snap_long(tables.calendar(spark, data_dir))


@query(
    "fourier_terms",
    "SELECT id, date, sales, CAST(isodow(date) AS INTEGER) AS weekday, "
    + ", ".join(
        f"round({wave}(2 * pi() * {k} * t / {sp}::DOUBLE), 6) AS {wave}_{str(sp).replace('.', '_')}_{k}"
        for sp, top in ((30.44, 1), (365.25, 3))
        for k in range(1, top + 1)
        for wave in ("sin", "cos")
    )
    + " FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY date) - 1 AS DOUBLE) AS t FROM sales_long)",
)
def fourier_terms(spark, data_dir):
    """Waves over the 0-based position of each series, and the weekday."""
    from tillweave.operators.windows import position_in_group

    panel = tables.sales_long(spark, data_dir)
    made = (
        panel.withColumn("t", position_in_group("id", "date"))
        .transform(calendars.fourier_terms, F.col("t"), [(30.44, 1), (365.25, 3)])
        .transform(calendars.calendar_effects)
        .drop("t")
    )
    waves = [c for c in made.columns if c.startswith(("sin_", "cos_"))]
    return made.select(
        "id", "date", "sales", "weekday", *[F.round(quoted(c), 6).alias(c.replace(".", "_")) for c in waves]
    )
