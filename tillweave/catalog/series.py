"""One row of features per series, for every product-location."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillweave.catalog.registry import query
from tillweave.operators import series
from tillweave.sources import sample_tables as tables


def rounded(df, digits=6):
    return df.select(
        *[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in df.schema]
    )


@query(
    "detrend_linear",
    """SELECT id, date, round(sales - (regr_intercept(sales, t) OVER w + regr_slope(sales, t) OVER w * t), 6) AS sales
       FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date) - 1 AS t FROM sales_long) WINDOW w AS (PARTITION BY id)""",
)
def detrend_linear(spark, data_dir):
    return rounded(series.detrend_linear(tables.sales_long(spark, data_dir)))


@query("deseasonalize_fourier")
def deseasonalize_fourier(spark, data_dir):
    yearly = series.deseasonalize_fourier(tables.sales_long(spark, data_dir), 365, 4)
    return series.deseasonalize_fourier(yearly, 7, 3)


def _wave_fit(y: str) -> str:
    """Coefficients of sine and cosine by Cramer's rule."""
    det = "(var_pop(sn) * var_pop(cs) - covar_pop(sn, cs) * covar_pop(sn, cs))"
    return f"""(covar_pop({y}, sn) * var_pop(cs) - covar_pop({y}, cs) * covar_pop(sn, cs)) / {det} AS {y}_sn,
               (covar_pop({y}, cs) * var_pop(sn) - covar_pop({y}, sn) * covar_pop(sn, cs)) / {det} AS {y}_cs"""


# Sales, and what a straight line leaves of them, with a wave of seven days.
WEEKLY = {
    "weekly": """SELECT id, date, y, sin(2 * pi() * t / 7.0::DOUBLE) AS sn, cos(2 * pi() * t / 7.0::DOUBLE) AS cs,
               y - (regr_intercept(y, t) OVER w + regr_slope(y, t) OVER w * t) AS u
        FROM (SELECT id, date, CAST(sales AS DOUBLE) AS y, row_number() OVER (PARTITION BY id ORDER BY date) - 1 AS t FROM sales_long)
        WINDOW w AS (PARTITION BY id)""",
    "weekly_fits": f"SELECT id, {_wave_fit('y')}, {_wave_fit('u')} FROM weekly GROUP BY id",
}


@query(
    "deseasonalize_weekly_wave",
    "SELECT id, date, round(y - y_sn * sn - y_cs * cs, 6) AS sales FROM weekly JOIN weekly_fits USING (id)",
    WEEKLY,
)
def deseasonalize_weekly_wave(spark, data_dir):
    """One wave, which two projections find."""
    return rounded(series.deseasonalize_fourier(tables.sales_long(spark, data_dir), 7, 1))


@query(
    "weekly_wave_strength",
    """SELECT id, round(neither / nullif(no_season, 0), 6) AS strength_trend, round(neither / nullif(no_trend, 0), 6) AS strength_seasonal
       FROM (SELECT id, var_samp(u - u_sn * sn - u_cs * cs) AS neither, var_samp(y - y_sn * sn - y_cs * cs) AS no_season, var_samp(u) AS no_trend
             FROM weekly JOIN weekly_fits USING (id) GROUP BY id)""",
    WEEKLY,
)
def weekly_wave_strength(spark, data_dir):
    return rounded(series.trend_season_strength(tables.sales_long(spark, data_dir), ((7, 1),)))


@query("trend_season_strength")
def trend_season_strength(spark, data_dir):
    return series.trend_season_strength(tables.sales_long(spark, data_dir))


@query(
    "binned_entropy",
    """SELECT id, round(-sum(p * ln(p)), 6) AS binned_entropy
       FROM (SELECT id, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY id) AS p
             FROM (SELECT id, least(floor(coalesce(CAST(sales - lo AS DOUBLE) / nullif(hi - lo, 0), 0) * 10), 9) AS bin
                   FROM (SELECT id, sales, min(sales) OVER (PARTITION BY id) AS lo, max(sales) OVER (PARTITION BY id) AS hi FROM sales_long))
             GROUP BY id, bin) GROUP BY id""",
)
def binned_entropy(spark, data_dir):
    return rounded(series.binned_entropy(tables.sales_long(spark, data_dir), 10))


@query(
    "c3",
    """SELECT id, round(avg(p), 6) AS c3 FROM (
         SELECT id, CAST(lead(sales, 56) OVER w AS DOUBLE) * lead(sales, 28) OVER w * sales AS p FROM sales_long
         WINDOW w AS (PARTITION BY id ORDER BY date)) GROUP BY id""",
)
def c3(spark, data_dir):
    return rounded(series.c3(tables.sales_long(spark, data_dir), 28))


@query(
    "cid_ce",
    """SELECT id, round(sqrt(sum(step * step)), 6) AS cid_ce FROM (
         SELECT id, z - lag(z) OVER (PARTITION BY id ORDER BY date) AS step FROM (
           SELECT id, date, (sales - avg(sales) OVER w) / nullif(stddev_samp(sales) OVER w, 0) AS z FROM sales_long WINDOW w AS (PARTITION BY id)))
       GROUP BY id""",
)
def cid_ce(spark, data_dir):
    return rounded(series.cid_ce(tables.sales_long(spark, data_dir)))


def _phi(m: int) -> str:
    return f"""SELECT id, sum(n * ln(n)) / sum(n) - ln(sum(n)) AS phi FROM (
        SELECT id, w, CAST(count(*) AS DOUBLE) AS n FROM (SELECT id, list(sales) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING) AS w
        FROM sales_long) WHERE len(w) = {m} GROUP BY id, w) GROUP BY id"""


@query(
    "approximate_entropy",
    "SELECT id, round(abs(a.phi - b.phi), 6) AS approximate_entropy FROM phi_five a JOIN phi_six b USING (id)",
    {"phi_five": _phi(5), "phi_six": _phi(6)},
)
def approximate_entropy(spark, data_dir):
    """Sales are whole numbers and the tolerance is below 1 here, so the twin
    counts identical windows; the distance form is tested on small series."""
    return rounded(series.approximate_entropy(tables.sales_long(spark, data_dir), 5, 0.0001))


@query("spectral_ar_entropy")
def spectral_ar_entropy(spark, data_dir):
    return series.spectral_ar_entropy(tables.sales_long(spark, data_dir))


AR_CTES = {
    "lagged": """SELECT id, CAST(sales AS DOUBLE) AS y, CAST(lag(sales, 1) OVER w AS DOUBLE) AS x1, CAST(lag(sales, 2) OVER w AS DOUBLE) AS x2
        FROM sales_long WINDOW w AS (PARTITION BY id ORDER BY date)"""
}


@query(
    "ar_order_one",
    """SELECT id, round(regr_slope(y, x1), 6) AS phi_1, round(regr_intercept(y, x1), 6) AS constant,
              round(regr_syy(y, x1) / regr_count(y, x1) * (1 - regr_r2(y, x1)), 4) AS variance FROM lagged WHERE x1 IS NOT NULL GROUP BY id""",
    AR_CTES,
)
def ar_order_one(spark, data_dir):
    """Autoregression of order one from lag products."""
    fitted = series.ar_coefficients(tables.sales_long(spark, data_dir), 1)
    return fitted.select("id", F.round(F.col("coefficients")[0], 6).alias("phi_1"), F.round("constant", 6).alias("constant"), F.round("variance", 4).alias("variance"))


@query(
    "ar_order_two",
    """SELECT id, round((c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12), 6) AS phi_1, round((c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12), 6) AS phi_2
       FROM (SELECT id, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2
             FROM lagged WHERE x2 IS NOT NULL GROUP BY id)""",
    AR_CTES,
)
def ar_order_two(spark, data_dir):
    """Autoregression of order two from lag products, by Cramer's rule in SQL."""
    fitted = series.ar_coefficients(tables.sales_long(spark, data_dir), 2)
    return fitted.select("id", *[F.round(F.col("coefficients")[i], 6).alias(f"phi_{i + 1}") for i in range(2)])

