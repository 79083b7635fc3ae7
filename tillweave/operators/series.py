"""One row of features per series, for all series at once.

A series has one value per day, so its length is bounded by the date range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.functions.maths import harmonic_angle, safe_divide
from tillweave.operators.regression import fit_by_group, gram_by_group, solve_ols
from tillweave.operators.relational import quoted

# The longest lag of the autoregression and the prior weight that
# keeps empty frequencies positive.
MAX_AR_LAG = 25
PRIOR_WEIGHT = 0.0001
# Days of a window that place it in a grid; each one triples the cells that a window is compared with.
GRID_DAYS = 2


def _ordered(id_col: str, date_col: str):
    return Window.partitionBy(id_col).orderBy(date_col)


def _position(id_col: str, date_col: str) -> Column:
    return F.row_number().over(_ordered(id_col, date_col)) - 1


def detrend_linear(
    df: DataFrame, value: str = "sales", id_col: str = "id", date_col: str = "date"
) -> DataFrame:
    """Replace the values by their distance from each series' straight line."""
    whole = Window.partitionBy(id_col)
    staged = df.withColumn("_t", _position(id_col, date_col))
    line = F.regr_intercept(value, "_t").over(whole) + F.regr_slope(value, "_t").over(whole) * F.col("_t")
    return staged.withColumn(value, F.col(value) - line).drop("_t")


def deseasonalize_fourier(
    df: DataFrame,
    period: float,
    harmonics: int,
    value: str = "sales",
    id_col: str = "id",
    date_col: str = "date",
) -> DataFrame:
    """Subtract the fitted sines and cosines of a period; the level stays.

    The waves count from each series' first row. A wave of half the period has
    no sine and is skipped by the solver.
    """
    waves = {}
    for k in range(1, harmonics + 1):
        angle = harmonic_angle(F.col("_t"), period, k)
        waves[f"_sin_{k}"], waves[f"_cos_{k}"] = F.sin(angle), F.cos(angle)
    staged = df.withColumn("_t", _position(id_col, date_col)).withColumns(waves)
    fitted = fit_by_group(staged, [id_col], list(waves), value).select(
        id_col, F.col("coefficients").alias("_coefficients")
    )
    season = F.lit(0.0)
    for i, name in enumerate(waves):
        season = season + F.col(name) * F.col("_coefficients")[i]
    return (
        staged.join(fitted, id_col)
        .withColumn(value, F.col(value) - season)
        .drop("_t", "_coefficients", *waves)
    )


def trend_season_strength(
    df: DataFrame,
    seasons: Sequence[tuple[float, int]] = ((365, 4), (7, 3)),
    value: str = "sales",
    id_col: str = "id",
    date_col: str = "date",
) -> DataFrame:
    """(id, strength_trend, strength_seasonal): variance ratios per series.

    Variance with trend and season removed, over the variance with only the
    season and only the trend removed. Series are read once, into one matrix of
    products of 1, time, all waves and the value; every residual is a
    combination of these columns, so its variance follows from the matrix.
    """
    waves: dict[str, Column] = {}
    steps: list[list[str]] = []
    for i, (period, harmonics) in enumerate(seasons):
        names = []
        for k in range(1, harmonics + 1):
            angle = harmonic_angle(F.col("_t"), period, k)
            waves[f"_sin_{i}_{k}"], waves[f"_cos_{i}_{k}"] = F.sin(angle), F.cos(angle)
            names += [f"_sin_{i}_{k}", f"_cos_{i}_{k}"]
        steps.append(names)
    features = ["_t", *waves]
    staged = df.withColumn("_t", _position(id_col, date_col)).withColumns(waves)
    grams = gram_by_group(staged, [id_col], features, value, {"model": None})
    places = [[1 + features.index(c) for c in names] for names in steps]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ratios = [_strengths(np.asarray(g), len(features) + 2, places) for g in batch["gram"]]
            yield pd.DataFrame({id_col: batch[id_col], "strength_trend": [r[0] for r in ratios], "strength_seasonal": [r[1] for r in ratios]})

    fields = [df.schema[id_col]]
    fields += [T.StructField(c, T.DoubleType()) for c in ("strength_trend", "strength_seasonal")]
    return grams.select(id_col, "gram").mapInPandas(solve, T.StructType(fields))


def _strengths(upper: np.ndarray, size: int, seasons: list[list[int]]) -> tuple[float | None, float | None]:
    """Both ratios from the upper triangle of the products of (1, t, waves, y)."""
    gram = np.zeros((size, size))
    gram[np.triu_indices(size)] = upper
    gram = gram + np.triu(gram, 1).T
    start = np.zeros(size)
    start[-1] = 1.0

    def without(residual: np.ndarray, columns: list[int], level: bool) -> np.ndarray:
        """The residual less its fit on some columns; the level goes too if asked."""
        basis = np.zeros((size, len(columns) + 2))
        basis[0, 0], basis[columns, range(1, len(columns) + 1)], basis[:, -1] = 1.0, 1.0, residual
        beta, intercept = solve_ols((basis.T @ gram @ basis)[None])
        left = residual.copy()
        left[columns] -= beta[0]
        if level:
            left[0] -= intercept[0]
        return left

    def spread(residual: np.ndarray) -> float:
        n = gram[0, 0]
        return (residual @ gram @ residual - (gram[0] @ residual) ** 2 / n) / (n - 1) if n > 1 else np.nan

    trend = without(start, [1], True)
    season, both = start, trend
    for columns in seasons:
        season, both = without(season, columns, False), without(both, columns, False)
    return tuple(float(spread(both) / s) if (s := spread(other)) > 0 else None for other in (season, trend))


def binned_entropy(df: DataFrame, bins: int = 10, value: str = "sales", id_col: str = "id") -> DataFrame:
    """Entropy of the values over equal-width bins between min and max.

    Two small aggregations: rows become counts per (id, value) first.
    """
    counts = df.groupBy(id_col, value).agg(F.count(F.lit(1)).alias("_n"))
    ends = df.groupBy(id_col).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_total"))
    width = safe_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    binned = counts.join(ends, id_col).withColumn(
        "_bin", F.least(F.floor(F.coalesce(width, F.lit(0.0)) * bins), F.lit(bins - 1))
    )
    share = F.col("_in_bin") / F.col("_total")
    return (
        binned.groupBy(id_col, "_bin")
        .agg(F.sum("_n").alias("_in_bin"), F.first("_total").alias("_total"))
        .groupBy(id_col)
        .agg((-F.sum(share * F.log(share)) + F.lit(0.0)).alias("binned_entropy"))
    )


def c3(df: DataFrame, lag: int = 28, value: str = "sales", id_col: str = "id", date_col: str = "date") -> DataFrame:
    """Mean of x(t + 2L) x(t + L) x(t) per series."""
    w, x = _ordered(id_col, date_col), F.col(value).cast("double")
    product = F.lead(x, 2 * lag).over(w) * F.lead(x, lag).over(w) * x
    return df.select(id_col, product.alias("_p")).groupBy(id_col).agg(F.avg("_p").alias("c3"))


def cid_ce(
    df: DataFrame, normalize: bool = True, value: str = "sales", id_col: str = "id", date_col: str = "date"
) -> DataFrame:
    """Root of the sum of squared steps, of the z-scored series if asked.

    The z-score divides every step by the sample std, so the std is taken out
    of the sum; a constant series gives null.
    """
    step = F.col(value).cast("double") - F.lag(F.col(value).cast("double")).over(_ordered(id_col, date_col))
    sums = (
        df.select(id_col, value, step.alias("_step"))
        .groupBy(id_col)
        .agg(F.sqrt(F.sum(F.col("_step") * F.col("_step"))).alias("_length"), F.stddev_samp(value).alias("_std"))
    )
    length = safe_divide(F.col("_length"), F.col("_std")) if normalize else F.col("_length")
    return sums.select(id_col, length.alias("cid_ce"))


def approximate_entropy(
    df: DataFrame,
    run_length: int = 5,
    filtering_level: float = 0.0001,
    value: str = "sales",
    id_col: str = "id",
    date_col: str = "date",
) -> DataFrame:
    """|phi(m) - phi(m + 1)| per series, with tolerance level x std.

    phi(m) is the mean log share of windows of length m within the tolerance of
    each window. Whole numbers closer than 1 are equal, so below a tolerance of
    1 similar windows are identical ones and are simply counted. Only windows of
    series with a wider tolerance (or fractional values) are compared, with
    those of near cells of a grid. Series of fewer than m + 1 days, and those
    with a null or NaN value, have null.
    """
    whole_numbers = isinstance(df.schema[value].dataType, T.IntegralType)
    # All windows are over the days of one series, so one shuffle serves them.
    series = Window.partitionBy(id_col)
    rows = df.select(
        id_col,
        date_col,
        F.col(value).cast("double").alias("_x"),
        (F.lit(filtering_level) * F.stddev_pop(value).over(series)).alias("_r"),
        F.max(F.col(value).isNull() | F.isnan(F.col(value).cast("double"))).over(series).alias("_gap"),
    )
    exact = F.lit(whole_numbers) & ~F.col("_gap") & F.coalesce(F.col("_r") < 1.0, F.lit(False))
    counted = _entropy_by_counts(rows.where(exact), run_length, id_col, date_col)
    compared = _entropy_by_distance(rows.where(~exact), run_length, id_col, date_col)
    return counted.unionByName(compared)


def _entropy_by_counts(rows: DataFrame, m: int, id_col: str, date_col: str) -> DataFrame:
    """Windows of length m + 1 are counted once; those of length m are their heads, and the last m days."""
    ahead = F.collect_list("_x").over(_ordered(id_col, date_col).rowsBetween(0, m))
    full = F.size("_w") == m + 1
    windows = rows.select(id_col, ahead.alias("_w")).select(
        id_col,
        F.when(F.size("_w") >= m, F.slice("_w", 1, m)).alias("_head"),
        F.when(full, F.col("_w")).alias("_full"),
    )
    seen = windows.groupBy(id_col, "_head", "_full").agg(F.count(F.lit(1)).alias("_n"))
    known = F.col("_full").isNotNull()
    heads = seen.groupBy(id_col, "_head").agg(
        F.sum("_n").alias("_n"),
        F.sum(F.when(known, F.col("_n"))).alias("_full_n"),
        F.sum(F.when(known, F.col("_n") * F.log("_n"))).alias("_full_log"),
    )
    n = F.when(F.col("_head").isNotNull(), F.col("_n"))
    # Each of the n identical windows has n similar ones.
    short = F.sum(n * F.log(n)) / F.sum(n) - F.log(F.sum(n))
    long = F.sum("_full_log") / F.sum("_full_n") - F.log(F.sum("_full_n"))
    return heads.groupBy(id_col).agg(F.abs(short - long).alias("approximate_entropy"))


def _entropy_by_distance(rows: DataFrame, m: int, id_col: str, date_col: str) -> DataFrame:
    """Windows are counted once each, put into cells as wide as the tolerance on their first days, and compared with
    those of the cells around them only. Cells are dealt over tasks, so a series meets no single one.

    A window has its m days and, but for the last one, the day after: the same pairs serve both lengths.
    """
    days = [f"_x{j}" for j in range(m + 1)]
    place, series = _ordered(id_col, date_col), Window.partitionBy(id_col)
    # The day after may be missing, the others not.
    windows = rows.select(
        id_col, "_r", "_gap", F.count(F.lit(1)).over(series).alias("_days"), *[F.lead("_x", j).over(place).alias(c) for j, c in enumerate(days)]
    )
    usable = ~F.col("_gap") & (F.col("_days") > m) & F.col(days[m - 1]).isNotNull()
    counted = windows.where(usable).groupBy(id_col, "_r", "_days", *days).agg(F.count(F.lit(1)).alias("_n"))
    # A little wider than the tolerance, so that rounding puts no similar window two cells away.
    wide = F.col("_r") * (1 + 1e-9)
    axes = days[: min(m, GRID_DAYS)]
    cells = {f"_cell{j}": F.when(F.col("_r") > 0, F.floor(F.col(c) / wide).cast("double")).otherwise(F.col(c)) for j, c in enumerate(axes)}
    own = counted.withColumns(cells)
    near = own.select(id_col, *days, "_n", *cells)
    for name in cells:
        steps = F.when(F.col("_r") > 0, F.array(*[F.col(name) + F.lit(float(k)) for k in (-1, 0, 1)])).otherwise(F.array(name))
        own = own.withColumn(name, F.explode(steps))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [id_col, *cells]]
    close = [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= F.col("a._r") for c in days]
    similar = reduce(and_, close[:m])
    pairs = own.alias("a").join(near.alias("b"), reduce(and_, [*same, similar]))
    keys = [F.col(f"a.{c}").alias(c) for c in [id_col, "_days", "_n", *days]]
    shares = pairs.groupBy(*keys).agg(F.sum("b._n").alias("_short"), F.sum(F.when(close[m], F.col("b._n"))).alias("_long"))

    def phi(found: str, length: int) -> Column:
        count = F.col("_days") - (length - 1)
        return F.sum(F.when(F.col(found).isNotNull(), F.col("_n") * F.log(F.col(found) / count) / count))

    entropy = shares.groupBy(id_col).agg(F.abs(phi("_short", m) - phi("_long", m + 1)).alias("approximate_entropy"))
    ids = rows.select(id_col).distinct()
    same_id = F.col(f"i.{id_col}").eqNullSafe(F.col(f"e.{id_col}"))
    return ids.alias("i").join(entropy.alias("e"), same_id, "left").select(F.col(f"i.{id_col}").alias(id_col), "approximate_entropy")


def _lagged(df: DataFrame, max_lag: int, value: str, id_col: str, date_col: str) -> tuple[DataFrame, list[str]]:
    """Rows with their place, the length of their series and the values of the days before; 0 before the first."""
    w, x = _ordered(id_col, date_col), F.col(quoted(value)).cast("double")
    lags = [f"_lag{k}" for k in range(1, max_lag + 1)]
    rows = df.select(id_col, date_col, x.alias("_x")).withColumns(
        {"_t": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(id_col))}
    )
    return rows.withColumns({c: F.coalesce(F.lag("_x", k).over(w), F.lit(0.0)) for k, c in enumerate(lags, 1)}), lags


def lag_products(
    df: DataFrame, max_lag: int = MAX_AR_LAG, value: str = "sales", id_col: str = "id", date_col: str = "date"
) -> DataFrame:
    """(id, n, known, spread, top, head, gram): what an autoregression of any order up to ``max_lag`` needs.

    ``gram`` holds the sums of products of 1, the lagged values and the value over the days from ``top`` on, the common
    sample of all orders; ``head`` the values before. A series is never gathered.
    """
    rows, lags = _lagged(df, max_lag, value, id_col, date_col)
    top = F.least(F.lit(max_lag), F.greatest(F.floor(F.col("_n") / 2) - 1, F.lit(0))).cast("int")
    rows = rows.withColumn("_top", top)
    grams = gram_by_group(rows.where(F.col("_t") >= F.col("_top")), [id_col], lags, "_x", {"model": None}).select(id_col, "gram")
    early = F.when(F.col("_t") < F.col("_top"), F.struct("_t", "_x"))
    ends = rows.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("_x").alias("known"),
        (F.max("_x") - F.min("_x")).alias("spread"),
        F.max("_top").alias("top"),
        F.transform(F.array_sort(F.collect_list(early)), lambda v: v["_x"]).alias("head"),
    )
    return ends.join(grams, id_col, "left")


def _full(upper: np.ndarray) -> np.ndarray:
    size = int((np.sqrt(8 * len(upper) + 1) - 1) / 2)
    gram = np.zeros((size, size))
    gram[np.triu_indices(size)] = upper
    return gram + np.triu(gram, 1).T


def _ar_order(gram: np.ndarray, top: int, rows: int) -> int:
    """The order of least AIC without a constant; the errors of all orders come from one order-recursive elimination."""
    work = gram[1:, 1:].copy()
    target = len(work) - 1
    best, order, scale = np.inf, 0, max(gram[-1, -1], 1e-300)
    for p in range(top + 1):
        if p:
            pivot = work[p - 1, p - 1]
            if pivot > 1e-12 * scale:  # a lag that the earlier ones determine takes nothing away
                work -= np.outer(work[:, p - 1], work[p - 1]) / pivot
        error = max(float(work[target, target]) / rows, 1e-300)
        aic = rows * np.log(error) + 2 * (p + 1)
        if aic < best - 1e-12:
            best, order = aic, p
    return order


def _ar_fit(gram: np.ndarray, head: np.ndarray, order: int) -> tuple[np.ndarray, float, float]:
    """(coefficients, constant, mean squared error) of one order with a constant, on all days from it on.

    The common sample starts at the end of ``head``; the days between are added.
    """
    places = [0, *range(1, order + 1), len(gram) - 1]
    part, rows = gram[np.ix_(places, places)], gram[0, 0]
    for t in range(order, len(head)):
        z = np.array([1.0, *(head[t - k] for k in range(1, order + 1)), head[t]])
        part, rows = part + np.outer(z, z), rows + 1
    beta, constant = solve_ols(part[None])
    fit = np.array([-constant[0], *-beta[0], 1.0])
    return beta[0], float(constant[0]), max(float(fit @ part @ fit) / rows, 0.0)


def ar_coefficients(
    df: DataFrame, order: int, value: str = "sales", id_col: str = "id", date_col: str = "date"
) -> DataFrame:
    """(id, constant, coefficients, variance) of an autoregression of a given order; null for a shorter series or one
    with a gap."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                made = (None, None, None)
                if row["gram"] is not None and row["known"] == row["n"] and row["top"] >= order:
                    beta, constant, error = _ar_fit(_full(np.asarray(row["gram"])), np.asarray(row["head"], float), order)
                    made = (constant, beta.tolist(), error)
                out.append((row[id_col], *made))
            yield pd.DataFrame(out, columns=[id_col, "constant", "coefficients", "variance"])

    fields = [df.schema[id_col], T.StructField("constant", T.DoubleType()), T.StructField("coefficients", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*fields, T.StructField("variance", T.DoubleType())])
    return lag_products(df, order, value, id_col, date_col).mapInPandas(solve, schema)


def _spectral_entropy(phi: np.ndarray, variance: float, n: int) -> float:
    frequencies = np.linspace(0.0, 0.5, int(np.ceil(n / 2)) + 1)
    turns = np.exp(-2j * np.pi * np.outer(frequencies, np.arange(1, len(phi) + 1)))
    density = variance / np.abs(1.0 - turns @ phi) ** 2
    shares = np.concatenate([density[:0:-1], density])
    shares = shares / shares.sum()
    shares = (1.0 - PRIOR_WEIGHT) * shares + PRIOR_WEIGHT / len(shares)
    return float(min(1.0, -(shares * np.log(shares)).sum() / np.log(n)))


def spectral_ar_entropy(
    df: DataFrame, max_lag: int = MAX_AR_LAG, value: str = "sales", id_col: str = "id", date_col: str = "date"
) -> DataFrame:
    """Entropy of the spectrum of an autoregression fitted to each series.

    Its order has the least AIC on a common sample without a constant, and is refitted with one; all of it from one
    row of lag products per series. Series of fewer than four days, constant ones and those with a gap have null.
    """

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                entropy, n = None, int(row["n"])
                if n >= 4 and row["known"] == n and row["spread"] > 0 and row["gram"] is not None:
                    gram, head = _full(np.asarray(row["gram"])), np.asarray(row["head"], float)
                    phi, _, variance = _ar_fit(gram, head, _ar_order(gram, int(row["top"]), n - int(row["top"])))
                    entropy = _spectral_entropy(phi, variance, n)
                out.append((row[id_col], entropy))
            yield pd.DataFrame(out, columns=[id_col, "spectral_entropy"])

    schema = T.StructType([df.schema[id_col], T.StructField("spectral_entropy", T.DoubleType())])
    return lag_products(df, max_lag, value, id_col, date_col).mapInPandas(solve, schema)
