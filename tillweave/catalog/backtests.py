"""Splits, weights, regressions, back-test and outlier reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillweave.catalog.pipelines import flagged_sales, regressors
from tillweave.catalog.registry import query
from tillweave.operators import regression, rolling
from tillweave.operators.relational import unnest_struct
from tillweave.operators.windows import day_trend, linear_ramp, rolling_std_days
from tillweave.plans import backtest, design, events
from tillweave.plans.calendar_features import calendar_fourier, weekday_flags
from tillweave.sources import sample_tables as tables
from tillweave.sources.sample_tables import EVENT_NAMES

TRAIN_DAYS, TEST_DAYS = backtest.TRAIN_DAYS, backtest.TEST_DAYS


def sample_splits(spark, data_dir) -> backtest.Splits:
    """Three years of training before the first test date, to the last date."""
    first_day, last_day = tables.date_bounds(spark, data_dir)
    return backtest.Splits(F.date_add(first_day, TRAIN_DAYS), last_day)


def daily_store_sales(spark, data_dir):
    """(date, store_id, state_id, sales, trend) with a day number as trend."""
    first_day, _ = tables.date_bounds(spark, data_dir)
    return (
        tables.sales_long(spark, data_dir)
        .join(tables.prodloc(spark, data_dir).select("id", "store_id", "state_id"), "id")
        .groupBy("date", "store_id", "state_id")
        .agg(F.sum("sales").alias("sales"))
        .withColumn("trend", F.datediff("date", first_day))
    )


def store_panel(spark, data_dir):
    return design.store_panel(
        flagged_sales(spark, data_dir), tables.prodloc(spark, data_dir), regressors(spark, data_dir)
    )


SPLITS_SQL = f"""SELECT CAST(i AS INTEGER) AS set_index, CAST(lo + {TRAIN_DAYS} + {TEST_DAYS} * i AS DATE) AS set_first_date
FROM bounds, (SELECT CAST(unnest(generate_series(0, 2000)) AS INTEGER) AS i) WHERE lo + {TRAIN_DAYS} + {TEST_DAYS} * (i + 1) <= hi"""
DAILY_SQL = """SELECT s.date, p.store_id, p.state_id, CAST(sum(s.sales) AS BIGINT) AS sales, CAST(s.date - lo AS INTEGER) AS trend
FROM sales_long s JOIN prodloc p ON s.id = p.id, bounds GROUP BY ALL"""
CTES = {"split_rows": SPLITS_SQL, "store_days": DAILY_SQL}


@query(
    "rolling_splits",
    f"""SELECT d.date, d.sales, s.set_index, s.set_first_date,
               CASE WHEN d.date < s.set_first_date THEN 'train' ELSE 'pred' END AS set_type
        FROM (SELECT date, CAST(sum(sales) AS BIGINT) AS sales FROM sales_long GROUP BY date) d
        JOIN split_rows s ON d.date >= s.set_first_date - {TRAIN_DAYS} AND d.date < s.set_first_date + {TEST_DAYS}""",
    CTES,
)
def rolling_splits(spark, data_dir):
    daily = tables.sales_long(spark, data_dir).groupBy("date").agg(F.sum("sales").alias("sales"))
    return backtest.rolling_splits(daily, sample_splits(spark, data_dir))


@query(
    "sample_weights",
    f"""SELECT set_index, date, round(CASE WHEN holiday THEN 1 ELSE ramp END, 9) AS sample_weights,
               round(CASE WHEN holiday THEN 1 ELSE ramp * ramp END, 9) AS sample_weights_x2,
               round(CASE WHEN holiday THEN 1 ELSE 1 / (1 + exp(-(trend - mid) * 0.01::DOUBLE)) END, 9) AS sample_weights_shifted_logistic
        FROM (SELECT s.set_index, c.date, c.date - lo AS trend, c.event_name_1 IS NOT NULL OR c.event_name_2 IS NOT NULL AS holiday,
                     0.2::DOUBLE + CAST(row_number() OVER (PARTITION BY s.set_index ORDER BY c.date) - 1 AS DOUBLE)
                       / (count(*) OVER (PARTITION BY s.set_index) - 1) * 0.8::DOUBLE AS ramp
              FROM calendar c JOIN split_rows s ON c.date >= s.set_first_date - {TRAIN_DAYS} AND c.date < s.set_first_date, bounds)
        JOIN (SELECT s.set_index, median(c.date - lo) AS mid FROM calendar c
              JOIN split_rows s ON c.date BETWEEN s.set_first_date - {TRAIN_DAYS} AND s.set_first_date + {TEST_DAYS}, bounds
              GROUP BY s.set_index) USING (set_index)""",
    CTES,
)
def sample_weights(spark, data_dir):
    calendar = tables.calendar(spark, data_dir)
    splits = sample_splits(spark, data_dir)
    dates = day_trend(calendar.select("date")).join(
        events.event_flags(calendar, EVENT_NAMES).select("date", "holiday_bool.*"), "date"
    )
    midpoints = backtest.trend_midpoints(backtest.split_windows(dates, splits))
    made = backtest.sample_weights(dates, midpoints, splits, EVENT_NAMES)
    return made.select("set_index", "date", *[F.round(c, 9).alias(c) for c in made.columns if c.startswith("sample")])


@query("trend_regimes_per_split")
def trend_regimes_per_split(spark, data_dir):
    dates = day_trend(tables.calendar(spark, data_dir).select("date"))
    _, memberships = backtest.trend_regimes_per_split(dates, sample_splits(spark, data_dir))
    return unnest_struct(memberships, "trend_guassian_splines")


def feature_panel(spark, data_dir):
    """Store sales with weekday flags, waves and events as plain columns."""
    calendar = tables.calendar(spark, data_dir)
    waves = calendar_fourier(calendar)
    features = (
        weekday_flags(waves)
        .select("date", "weekday_bool.*", "year_month_trigonometric.*")
        .join(events.event_flags(calendar, EVENT_NAMES).select("date", "holiday_bool.*"), "date")
    )
    names = [c for c in features.columns if c != "date"]
    return daily_store_sales(spark, data_dir).join(features, "date"), names


@query("lasso_by_group")
def lasso_by_group(spark, data_dir):
    """Predictions and residuals of one lasso per state and store."""
    panel, names = feature_panel(spark, data_dir)
    keys = ["state_id", "store_id"]
    fitted = regression.fit_by_group(panel, keys, names, "sales", alpha=backtest.LASSO_ALPHA)
    return regression.predict_by_group(panel, fitted, keys, names, "sales").select(
        "date", *keys, "sales", "prediction", "residual"
    )


def ramp_weighted(panel):
    return panel.withColumn("sample_weights", linear_ramp(0.2, 1.0, ["state_id", "store_id"], "date"))


@query("weighted_lasso_by_group")
def weighted_lasso_by_group(spark, data_dir):
    """Coefficients of one weighted lasso per state and store."""
    panel, names = feature_panel(spark, data_dir)
    keys = ["state_id", "store_id"]
    fitted = regression.fit_by_group(
        ramp_weighted(panel), keys, names, "sales", alpha=backtest.LASSO_ALPHA, weight="sample_weights"
    )
    return regression.coefficients_long(fitted, keys, names)


@query("weighted_ols_by_group")
def weighted_ols_by_group(spark, data_dir):
    """Residuals of weighted least squares per state and store."""
    panel, names = feature_panel(spark, data_dir)
    keys = ["state_id", "store_id"]
    fitted = regression.fit_by_group(ramp_weighted(panel), keys, names, "sales", weight="sample_weights")
    return regression.predict_by_group(panel, fitted, keys, names, "sales").select("date", *keys, "residual")


@query(
    "weighted_ols_one_regressor",
    """SELECT state_id, store_id, round(slope, 6) AS slope, round((swy - slope * swx) / sw, 6) AS intercept
       FROM (SELECT *, (sw * swxy - swx * swy) / (sw * swxx - swx * swx) AS slope
             FROM (SELECT state_id, store_id, sum(w) AS sw, sum(w * trend) AS swx, sum(w * sales) AS swy, sum(w * trend * sales) AS swxy,
                          sum(w * trend * trend) AS swxx
                   FROM (SELECT *, 0.2::DOUBLE + CAST(row_number() OVER (PARTITION BY store_id ORDER BY date) - 1 AS DOUBLE)
                                   / (count(*) OVER (PARTITION BY store_id) - 1) * 0.8::DOUBLE AS w FROM store_days)
                   GROUP BY state_id, store_id))""",
    CTES,
)
def weighted_ols_one_regressor(spark, data_dir):
    keys = ["state_id", "store_id"]
    panel = ramp_weighted(daily_store_sales(spark, data_dir))
    fitted = regression.fit_by_group(panel, keys, ["trend"], "sales", weight="sample_weights")
    return fitted.select(
        *keys, F.round(F.col("coefficients")[0], 6).alias("slope"), F.round("intercept", 6).alias("intercept")
    )


@query(
    "lasso_one_regressor",
    """SELECT state_id, store_id, round(slope, 6) AS slope, round(my - slope * mx, 6) AS intercept
       FROM (SELECT *, sign(c) * greatest(abs(c) - 150, 0) / v AS slope
             FROM (SELECT state_id, store_id, covar_pop(sales, trend) AS c, var_pop(trend) AS v, avg(sales) AS my, avg(trend) AS mx
                   FROM store_days GROUP BY state_id, store_id))""",
    CTES,
)
def lasso_one_regressor(spark, data_dir):
    """With one regressor the lasso is a soft threshold of the covariance."""
    keys = ["state_id", "store_id"]
    fitted = regression.fit_by_group(daily_store_sales(spark, data_dir), keys, ["trend"], "sales", alpha=150.0)
    return fitted.select(
        *keys, F.round(F.col("coefficients")[0], 6).alias("slope"), F.round("intercept", 6).alias("intercept")
    )


TWO_REGRESSORS = {
    **CTES,
    "two_rows": """SELECT state_id, store_id, CAST(sales AS DOUBLE) AS y, trend / 100.0::DOUBLE AS x1, sin(trend / 58.0::DOUBLE) AS x2,
        0.2::DOUBLE + CAST(row_number() OVER (PARTITION BY store_id ORDER BY date) - 1 AS DOUBLE)
            / (count(*) OVER (PARTITION BY store_id) - 1) * 0.8::DOUBLE AS w FROM store_days""",
    "two_sums": """SELECT state_id, store_id, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS c1,
        covar_pop(x2, y) AS c2, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM two_rows GROUP BY state_id, store_id""",
}
TWO_ALPHA = 30.0
# Every set of columns in use and every choice of signs has one stationary point; the least valid one is the minimum.
TWO_REGRESSORS["two_best"] = f"""
SELECT state_id, store_id, arg_min({{'b1': b1, 'b2': b2}}, 0.5 * (b1 * b1 * s11 + 2 * b1 * b2 * s12 + b2 * b2 * s22) - b1 * c1 - b2 * c2
    + {TWO_ALPHA} * (abs(b1) + abs(b2))) AS b, any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my
FROM (
  SELECT *, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM two_sums
  UNION ALL SELECT *, sign(c1) * greatest(abs(c1) - {TWO_ALPHA}, 0) / s11, 0 FROM two_sums
  UNION ALL SELECT *, 0, sign(c2) * greatest(abs(c2) - {TWO_ALPHA}, 0) / s22 FROM two_sums
  UNION ALL SELECT * EXCLUDE (t1, t2) FROM (
    SELECT s.*, ((c1 - {TWO_ALPHA} * t1) * s22 - (c2 - {TWO_ALPHA} * t2) * s12) / (s11 * s22 - s12 * s12) AS b1,
           ((c2 - {TWO_ALPHA} * t2) * s11 - (c1 - {TWO_ALPHA} * t1) * s12) / (s11 * s22 - s12 * s12) AS b2, t1, t2
    FROM two_sums s, (SELECT unnest([-1.0, 1.0]) AS t1), (SELECT unnest([-1.0, 1.0]) AS t2))
  WHERE b1 * t1 > 0 AND b2 * t2 > 0)
GROUP BY state_id, store_id"""


def two_regressors(spark, data_dir):
    day = F.col("trend")
    return daily_store_sales(spark, data_dir).withColumns({"x1": day / 100.0, "x2": F.sin(day / 58.0)})


def two_regressor_lasso(spark, data_dir):
    keys = ["state_id", "store_id"]
    return regression.fit_by_group(two_regressors(spark, data_dir), keys, ["x1", "x2"], "sales", alpha=TWO_ALPHA)


@query(
    "lasso_two_regressors",
    """SELECT state_id, store_id, round(b.b1, 6) AS x1, round(b.b2, 6) AS x2, round(my - b.b1 * m1 - b.b2 * m2, 6) AS intercept, true AS converged
       FROM two_best""",
    TWO_REGRESSORS,
)
def lasso_two_regressors(spark, data_dir):
    """Two columns against all stationary points; the duality gap says whether a fit is done."""
    fitted = two_regressor_lasso(spark, data_dir)
    spread = two_regressors(spark, data_dir).groupBy("state_id", "store_id").agg(F.var_pop("sales").alias("spread"))
    return fitted.join(spread, ["state_id", "store_id"]).select(
        "state_id", "store_id", *[F.round(F.col("coefficients")[i], 6).alias(c) for i, c in enumerate(["x1", "x2"])],
        F.round("intercept", 6).alias("intercept"), (F.col("gap") <= regression.GAP_TOLERANCE * F.col("spread")).alias("converged"),
    )


@query(
    "weighted_ols_two_regressors",
    """SELECT state_id, store_id, round((c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12), 6) AS x1,
              round((c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12), 6) AS x2
       FROM (SELECT state_id, store_id, sum(w * x1 * x1) - sum(w * x1) * sum(w * x1) / sum(w) AS s11,
                    sum(w * x2 * x2) - sum(w * x2) * sum(w * x2) / sum(w) AS s22, sum(w * x1 * x2) - sum(w * x1) * sum(w * x2) / sum(w) AS s12,
                    sum(w * x1 * y) - sum(w * x1) * sum(w * y) / sum(w) AS c1, sum(w * x2 * y) - sum(w * x2) * sum(w * y) / sum(w) AS c2
             FROM two_rows GROUP BY state_id, store_id)""",
    TWO_REGRESSORS,
)
def weighted_ols_two_regressors(spark, data_dir):
    """Weighted least squares on two columns, by Cramer's rule in SQL."""
    keys = ["state_id", "store_id"]
    panel = ramp_weighted(two_regressors(spark, data_dir))
    fitted = regression.fit_by_group(panel, keys, ["x1", "x2"], "sales", weight="sample_weights")
    return fitted.select(*keys, *[F.round(F.col("coefficients")[i], 6).alias(c) for i, c in enumerate(["x1", "x2"])])


@query(
    "lasso_optimality",
    """SELECT state_id, store_id, variable, true AS optimal FROM (SELECT DISTINCT state_id, store_id FROM store_days),
       (SELECT unnest(['trend', 'trend_sq', 'wave']) AS variable)""",
    CTES,
)
def lasso_optimality(spark, data_dir):
    """Conditions that only the minimum meets: the mean product of residual and feature is at most alpha, and
    alpha with the coefficient's sign where that is not zero."""
    keys, names, alpha = ["state_id", "store_id"], ["trend", "trend_sq", "wave"], 5.0
    panel = daily_store_sales(spark, data_dir).withColumns(
        {"trend_sq": F.col("trend") * F.col("trend") / 1000.0, "wave": F.sin(F.col("trend") / 58.0)}
    )
    fitted = regression.fit_by_group(panel, keys, names, "sales", alpha=alpha)
    made = regression.predict_by_group(panel, fitted, keys, names, "sales")
    products = made.groupBy(*keys).agg(*[F.avg(F.col(c) * F.col("residual")).alias(c) for c in names])
    slopes = products.unpivot(keys, names, "variable", "slope")
    coefficients = regression.coefficients_long(fitted, keys, names)
    # Sums of about a thousand rows of large features: equal to 1e-4 of their size.
    size = panel.groupBy(*keys).agg(*[F.sqrt(F.avg(F.col(c) * F.col(c)) * F.avg(F.col("sales") * F.col("sales"))).alias(c) for c in names])
    slack = size.unpivot(keys, names, "variable", "size")
    both = slopes.join(coefficients, [*keys, "variable"]).join(slack, [*keys, "variable"])
    near = F.abs(F.col("slope") - F.signum("value") * alpha) <= F.col("size") * 1e-4
    return both.select(
        *keys, "variable", F.when(F.col("value") == 0, F.abs("slope") <= alpha + F.col("size") * 1e-4).otherwise(near).alias("optimal")
    )


SPLIT_ALPHA = 150.0
SPLIT_FITS = {
    **CTES,
    "split_sales": f"""SELECT s.set_index, s.set_first_date, d.*, CASE WHEN d.date < s.set_first_date THEN 'train' ELSE 'pred' END AS set_type
        FROM store_days d JOIN split_rows s ON d.date >= s.set_first_date - {TRAIN_DAYS} AND d.date < s.set_first_date + {TEST_DAYS}""",
    "split_fits": f"""SELECT set_index, state_id, store_id, slope, my - slope * mx AS intercept
        FROM (SELECT *, sign(c) * greatest(abs(c) - {SPLIT_ALPHA}, 0) / v AS slope
              FROM (SELECT set_index, state_id, store_id, covar_pop(sales, trend) AS c, var_pop(trend) AS v, avg(sales) AS my, avg(trend) AS mx
                    FROM split_sales WHERE set_type = 'train' GROUP BY set_index, state_id, store_id))""",
}


def split_fits(spark, data_dir):
    """(panel, windows, coefficients): a lasso on the trend in every split and store, from cumulative sums."""
    splits = sample_splits(spark, data_dir)
    panel = daily_store_sales(spark, data_dir)
    days = backtest.split_windows(panel.select("date", "trend").distinct(), splits)
    known = days.withColumn("set_first_date", splits.first_date(F.col("set_index")))
    windows = rolling.collect_windows(known, [], splits.train_days, splits.test_days)
    grams = rolling.window_grams(panel, backtest.OVER, ["trend"], "sales", windows, [], {"lasso": None})
    return panel, windows, regression.solve_models(grams, ["set_index", *backtest.OVER], ["trend"], {"lasso": ["trend"]}, SPLIT_ALPHA)


@query(
    "rolling_lasso_one_regressor",
    "SELECT set_index, state_id, store_id, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM split_fits",
    SPLIT_FITS,
)
def rolling_lasso_one_regressor(spark, data_dir):
    """With one regressor the lasso of a split is a soft threshold of its covariance."""
    _, _, fitted = split_fits(spark, data_dir)
    return fitted.select(
        "set_index", *backtest.OVER, F.round(F.col("coefficients")[0], 6).alias("slope"), F.round("intercept", 6).alias("intercept")
    )


@query(
    "backtest_metrics_one_regressor",
    """SELECT set_index, set_type, CAST(count(*) AS BIGINT) AS n, round(sum(abs(sales - f)) / sum(sales), 6) AS wape,
              round(sqrt(avg((sales - f) * (sales - f))), 6) AS rmse, round(sum(f) / sum(sales), 6) AS bias
       FROM (SELECT r.*, intercept + slope * trend AS f FROM split_sales r JOIN split_fits USING (set_index, state_id, store_id))
       GROUP BY set_index, set_type""",
    SPLIT_FITS,
)
def backtest_metrics_one_regressor(spark, data_dir):
    """Predictions of all splits and their errors per split."""
    from tillweave.functions import metrics

    panel, windows, fitted = split_fits(spark, data_dir)
    rows = rolling.window_predictions(panel, fitted, backtest.OVER, ["trend"], "sales", windows, [], {"lasso": ["trend"]})
    y, f = F.col("sales"), F.col("lasso_prediction")
    measures = [F.round(getattr(metrics, name)(y, f), 6).alias(name) for name in ("wape", "rmse", "bias")]
    return rows.groupBy("set_index", "set_type").agg(F.count(F.lit(1)).alias("n"), *measures)


@query(
    "rolling_std_per_split",
    """SELECT set_index, set_type, date, state_id, store_id, round(coalesce(std, lead(std) OVER w), 6) AS rolling_row_std
       FROM (SELECT *, stddev_samp(sales) OVER (PARTITION BY set_index, set_type, store_id ORDER BY date
                       RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS std FROM split_sales)
       WINDOW w AS (PARTITION BY set_index, set_type, store_id ORDER BY date)""",
    SPLIT_FITS,
)
def rolling_std_per_split(spark, data_dir):
    panel, windows, fitted = split_fits(spark, data_dir)
    rows = rolling.window_predictions(panel, fitted, backtest.OVER, ["trend"], "sales", windows, [], {"lasso": ["trend"]})
    return rows.select("set_index", "set_type", "date", *backtest.OVER, F.round("rolling_row_std", 6).alias("rolling_row_std"))


def simple_coefficients(daily):
    """Straight line per store by aggregates, in the shape of fitted models.
    The second feature has coefficient 0."""
    return daily.groupBy("store_id").agg(
        F.array(F.regr_slope("sales", "trend"), F.lit(0.0)).alias("coefficients"),
        F.regr_intercept("sales", "trend").alias("intercept"),
    )


LINES = {
    **CTES,
    "lines": "SELECT store_id, regr_slope(sales, trend) AS slope, regr_intercept(sales, trend) AS intercept FROM store_days GROUP BY store_id",
    "residual_rows": """SELECT d.date, d.store_id, d.state_id, d.sales, d.trend, round(intercept + slope * trend, 6) AS prediction,
        round(sales - (intercept + slope * trend), 6) AS residual FROM store_days d JOIN lines l ON d.store_id = l.store_id""",
}


def line_residuals(spark, data_dir):
    daily = daily_store_sales(spark, data_dir)
    shown = regression.predict_by_group(
        daily.withColumn("zero", F.lit(0.0)), simple_coefficients(daily), ["store_id"], ["trend", "zero"], "sales"
    )
    return shown.withColumns({c: F.round(c, 6) for c in ("prediction", "residual")}).drop("zero")


@query("predict_from_coefficients", "SELECT * FROM residual_rows", LINES)
def predict_from_coefficients(spark, data_dir):
    return line_residuals(spark, data_dir)


@query(
    "backtest_counts",
    f"""SELECT s.set_index, s.set_first_date, CASE WHEN f.date < s.set_first_date THEN 'train' ELSE 'pred' END AS set_type, f.state_id, f.store_id,
               CAST(count(*) AS BIGINT) AS n, CAST(sum(f.sales) AS BIGINT) AS sales, CAST(count(*) AS BIGINT) AS predicted
        FROM (SELECT o.date, p.state_id, p.store_id, sum(o.sales) AS sales FROM sales_oos o JOIN prodloc p ON o.id = p.id GROUP BY ALL) f
        JOIN split_rows s ON f.date >= s.set_first_date - {TRAIN_DAYS} AND f.date < s.set_first_date + {TEST_DAYS}
        GROUP BY ALL""",
    CTES,
)
def backtest_counts(spark, data_dir):
    """Rows, sales and predictions of the whole back-test per split, set and store."""
    rows, _ = backtest.backtest_panel(store_panel(spark, data_dir), sample_splits(spark, data_dir))
    both = F.col("lasso_prediction").isNotNull() & F.col("weigthed_lasso_prediction").isNotNull()
    return rows.groupBy("set_index", "set_first_date", "set_type", *backtest.OVER).agg(
        F.count(F.lit(1)).alias("n"), F.sum("sales").alias("sales"), F.count_if(both).alias("predicted")
    )


@query("backtest_panel")
def backtest_panel(spark, data_dir):
    """All splits, both models, train and test rows."""
    rows, _ = backtest.backtest_panel(store_panel(spark, data_dir), sample_splits(spark, data_dir))
    return rows.select(*backtest.BACKTEST_COLUMNS)


@query("backtest_metrics")
def backtest_metrics(spark, data_dir):
    """Errors of both models on train and test rows."""
    rows, _ = backtest.backtest_panel(store_panel(spark, data_dir), sample_splits(spark, data_dir))
    return backtest.error_metrics(rows, ["set_type"])


@query(
    "coefficients_long",
    """SELECT state_id, store_id, 'x1' AS variable, round(b.b1, 6) AS value FROM two_best
       UNION ALL SELECT state_id, store_id, 'x2', round(b.b2, 6) FROM two_best""",
    TWO_REGRESSORS,
)
def coefficients_long(spark, data_dir):
    fitted = two_regressor_lasso(spark, data_dir)
    return regression.coefficients_long(fitted, ["state_id", "store_id"], ["x1", "x2"]).withColumn("value", F.round("value", 6))


@query(
    "unused_features",
    """SELECT 'x1' AS variable FROM two_best WHERE b.b1 = 0 UNION SELECT 'x2' FROM two_best WHERE b.b2 = 0""",
    TWO_REGRESSORS,
)
def unused_features(spark, data_dir):
    """Columns that the lasso leaves out for some store."""
    fitted = two_regressor_lasso(spark, data_dir)
    return regression.unused_features(regression.coefficients_long(fitted, ["state_id", "store_id"], ["x1", "x2"]))


OUTLIERS = {
    **LINES,
    "tail_rows": """SELECT r.*, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day_month FROM residual_rows r,
        (SELECT quantile_disc(residual, 0.01) AS q_lo, quantile_disc(residual, 0.99) AS q_hi FROM residual_rows)
        WHERE residual <= q_lo OR residual >= q_hi""",
}


@query(
    "outlier_days",
    """SELECT month, day_month, CAST(count(*) AS BIGINT) AS residual_count, round(ln(sum(abs(residual))), 6) AS residual_sum,
              round(ln(avg(abs(residual))), 6) AS residual_mean, string_agg(DISTINCT CAST(date AS VARCHAR), ',' ORDER BY CAST(date AS VARCHAR)) AS dates,
              string_agg(DISTINCT store_id, ',' ORDER BY store_id) AS stores FROM tail_rows GROUP BY month, day_month""",
    OUTLIERS,
)
def outlier_days(spark, data_dir):
    made = backtest.outlier_days(line_residuals(spark, data_dir))
    return made.withColumns(
        {
            "residual_sum": F.round("residual_sum", 6),
            "residual_mean": F.round("residual_mean", 6),
            "dates": F.array_join(F.col("dates").cast("array<string>"), ","),
            "stores": F.array_join("stores", ","),
        }
    )


@query("outlier_clusters")
def outlier_clusters(spark, data_dir):
    made = backtest.outlier_clusters(backtest.outlier_days(line_residuals(spark, data_dir)))
    return unnest_struct(
        made.drop("dates", "stores"), "residual_sum_regimes", "residual_mean_regimes", "residual_count_regimes"
    )


@query(
    "outlier_events",
    """SELECT DISTINCT e.event_name AS variable FROM event_days e JOIN tail_rows t ON month(e.date) = t.month AND day(e.date) = t.day_month""",
    OUTLIERS,
)
def outlier_events(spark, data_dir):
    outliers = backtest.outlier_days(line_residuals(spark, data_dir))
    return backtest.outlier_events(outliers, events.event_flags(tables.calendar(spark, data_dir), EVENT_NAMES))


@query(
    "forecast_long",
    """SELECT store_id, date, variable, value FROM (
         SELECT store_id, date, CAST(sales AS DOUBLE) AS sales_value, prediction, residual,
                round(stddev_samp(sales) OVER (PARTITION BY store_id ORDER BY date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW), 6) AS rolling_row_std
         FROM residual_rows) UNPIVOT INCLUDE NULLS (value FOR variable IN (sales_value, prediction, residual, rolling_row_std))""",
    LINES,
)
def forecast_long(spark, data_dir):
    rolling = F.round(rolling_std_days("sales", "store_id", "date", 30), 6)
    rows = line_residuals(spark, data_dir).withColumns(
        {"rolling_row_std": rolling, "sales_value": F.col("sales").cast("double")}
    )
    return backtest.forecast_long(
        rows, ["store_id", "date"], ["sales_value", "prediction", "residual", "rolling_row_std"]
    )
