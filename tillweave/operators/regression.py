"""Linear models per group from sums of products.

Rows are read once. Each task adds up the products of its rows per group, the
partial sums are added after a shuffle of one short row per task and group,
and a model is solved from that one row: a group of any size is never
gathered. Features of a row are plain double columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.operators.relational import quoted

# A task hands on its partial sums when it holds this many groups.
GROUPS_IN_TASK = 200
# A fit is done when its duality gap is this share of the objective at zero.
GAP_TOLERANCE = 1e-11
# Pivots and eigenvalues of unit columns below this count as zero.
SINGULAR = 1e-10


def gram_by_group(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    target: str,
    weights: Mapping[str, str | None],
) -> DataFrame:
    """Sums of products per group: (keys, model, rows, gram).

    ``weights`` names the models and the weight column of each (None for equal
    weights). ``gram`` is the upper triangle of Z'WZ for Z = [1, features,
    target]. A row counts for a model if key, features, target and that model's
    own weight are there; NaN is taken as missing.
    """
    keys, features, models = list(keys), list(features), dict(weights)
    used = [c for c in models.values() if c is not None]
    needed = list(dict.fromkeys([*keys, *features, target, *used]))
    size = len(features) + 2
    upper = np.triu_indices(size)

    def emit(sums: dict) -> pd.DataFrame:
        rows = [(*key, model, count, gram[upper]) for (key, model), (count, gram) in sums.items()]
        return pd.DataFrame(rows, columns=[*keys, "model", "rows", "gram"])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            whole = batch.dropna(subset=[*keys, *features, target])
            for key, rows in whole.groupby(keys, sort=False):
                z = np.ones((len(rows), size))
                z[:, 1:-1] = rows[features].to_numpy(dtype=float)
                z[:, -1] = rows[target].to_numpy(dtype=float)
                for model, weight in models.items():
                    if weight is None:
                        held, gram = len(rows), z.T @ z
                    else:
                        w = rows[weight].to_numpy(dtype=float)
                        known = ~np.isnan(w)
                        held, gram = int(known.sum()), z[known].T @ (z[known] * w[known, None])
                    if held:
                        count, old = sums.get((key, model), (0, 0.0))
                        sums[key, model] = (count + held, old + gram)
                if len(sums) > GROUPS_IN_TASK:
                    yield emit(sums)
                    sums = {}
        if sums:
            yield emit(sums)

    # Nulls go inside the tasks: a filter over all columns would make Spark
    # derive a constraint for every combination of their aliases.
    rows = df.select(*[F.col(quoted(c)) for c in needed])
    fields = [rows.schema[c] for c in keys]
    fields += [
        T.StructField("model", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("gram", T.ArrayType(T.DoubleType())),
    ]
    parts = rows.mapInPandas(partial, T.StructType(fields))
    return (
        parts.groupBy(*keys, "model")
        .agg(F.sum("rows").alias("rows"), Summarizer.sum(array_to_vector("gram")).alias("gram"))
        .withColumn("gram", vector_to_array("gram"))
    )


def _centred(gram: np.ndarray):
    """Covariances about the weighted means, for a stack of Gram matrices."""
    total = gram[:, 0, 0]
    means = gram[:, 0, 1:] / total[:, None]
    centred = gram[:, 1:, 1:] - total[:, None, None] * means[:, :, None] * means[:, None, :]
    return centred[:, :-1, :-1], centred[:, :-1, -1], centred[:, -1, -1], means[:, :-1], means[:, -1]


def duality_gap(xx: np.ndarray, xy: np.ndarray, yy: float, penalty: np.ndarray, beta: np.ndarray) -> tuple[float, np.ndarray]:
    """Gap of 1/2 |y - Xb|^2 + sum penalty |b| between b and the dual point of its residual, from products alone.

    Also marks the columns that are zero in every solution: those whose product with any dual point in the sphere of
    that gap stays under their penalty.
    """
    gradient = xy - xx @ beta
    ry = yy - beta @ xy
    rr = max(ry - beta @ gradient, 0.0)
    share = 1.0
    over = np.abs(gradient) > penalty
    if over.any():
        share = float((penalty[over] / np.abs(gradient[over])).min())
    gap = max(0.5 * rr + float(penalty @ np.abs(beta)) - (share * ry - 0.5 * share * share * rr), 0.0)
    size = np.sqrt(np.maximum(np.diag(xx), 0.0))
    return gap, share * np.abs(gradient) + np.sqrt(2.0 * gap) * size < penalty * (1.0 - 1e-9)


def _step(xx: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, bool]:
    """(direction, whole): the step to the least of a quadratic with this slope; where columns depend on each other
    and the slope points along them, that direction, without end."""
    try:
        lower = np.linalg.cholesky(xx)
        if np.diag(lower).min() ** 2 > SINGULAR:
            return np.linalg.solve(xx, slope), True
    except np.linalg.LinAlgError:
        pass
    value, axes = np.linalg.eigh(xx)
    flat = value < SINGULAR * max(value[-1], 1.0)
    along = axes.T @ slope
    if np.abs(along[flat]).max(initial=0.0) > 1e-9 * max(np.abs(slope).max(), 1e-300):
        return axes[:, flat] @ along[flat], False
    return axes[:, ~flat] @ (along[~flat] / value[~flat]), True


def _settle(xx: np.ndarray, xy: np.ndarray, penalty: np.ndarray, beta: np.ndarray, signs: np.ndarray) -> None:
    """Move to the least objective with these signs; a coefficient that would change its sign on the way goes out."""
    while True:
        held = np.flatnonzero(signs)
        if not len(held):
            return
        part = xx[np.ix_(held, held)]
        move, whole = _step(part, xy[held] - part @ beta[held] - penalty[held] * signs[held])
        back = move * signs[held] < 0
        reach = np.full(len(held), np.inf)
        reach[back] = np.abs(beta[held][back]) / np.abs(move[back])
        nearest = reach.min()
        if whole and nearest >= 1.0:
            beta[held] += move
            return
        if not np.isfinite(nearest):
            return
        beta[held] += nearest * move
        out = held[reach <= nearest]
        beta[out], signs[out] = 0.0, 0.0


def lasso_by_active_set(xx: np.ndarray, xy: np.ndarray, yy: float, penalty: np.ndarray) -> tuple[np.ndarray, float]:
    """(coefficients, gap) of 1/2 |y - Xb|^2 + sum penalty |b| for columns of unit length, by an active set.

    It starts from least squares or from zero, whichever is lower. The column that breaks its condition most enters
    with the sign of its product, and the set is settled. The objective falls with every move, so no set comes twice.
    It ends when the gap is small, or when no column can enter. Screened columns never enter.
    """
    beta = np.linalg.solve(xx + SINGULAR * np.eye(len(xy)), xy) if len(xy) else np.zeros(0)
    if 0.5 * beta @ xx @ beta - beta @ xy + penalty @ np.abs(beta) >= 0:
        beta = np.zeros(len(xy))
    signs, gone = np.sign(beta), np.zeros(len(xy), bool)
    _settle(xx, xy, penalty, beta, signs)
    while True:
        gap, screened = duality_gap(xx, xy, yy, penalty, beta)
        if gap <= GAP_TOLERANCE * max(yy, 1e-300) / 2:
            return beta, gap
        gone |= screened & (signs == 0)
        gradient = xy - xx @ beta
        excess = np.where((signs != 0) | gone, -np.inf, np.abs(gradient) - penalty)
        enter = int(excess.argmax())
        if excess[enter] <= 1e-13 * np.sqrt(max(yy, 1e-300)):
            return beta, gap
        signs[enter] = np.sign(gradient[enter])
        _settle(xx, xy, penalty, beta, signs)
        gone[enter] |= signs[enter] == 0  # it entered by rounding alone


def solve_lasso(gram: np.ndarray, rows: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients and intercepts minimizing 1/(2n) sum w (y - Xb - b0)^2 + alpha |b|_1, and duality gaps.

    The intercept carries no penalty. The gap bounds how far the objective is above its least value.
    """
    xx, xy, yy, x_mean, y_mean = _centred(gram)
    models, p = xy.shape
    diagonal = np.einsum("mpp->mp", xx)
    raw = np.einsum("mpp->mp", gram)[:, 1:-1]
    # A column without spread inside the group has no coefficient.
    live = diagonal > 1e-10 * np.maximum(raw, 1e-300)
    beta, gaps = np.zeros((models, p)), np.zeros(models)
    for m in range(models):
        used = np.flatnonzero(live[m])
        unit = 1.0 / np.sqrt(diagonal[m, used])
        scaled = xx[m][np.ix_(used, used)] * unit[:, None] * unit
        found, gap = lasso_by_active_set(scaled, xy[m, used] * unit, float(yy[m]), alpha * float(rows[m]) * unit)
        beta[m, used], gaps[m] = found * unit, gap / float(rows[m])
    return beta, y_mean - (beta * x_mean).sum(axis=1), gaps


def solve_ols(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least squares by pseudo-inverse, as indicator columns with an intercept
    are collinear: fitted values are unique, coefficients the shortest ones."""
    xx, xy, _, x_mean, y_mean = _centred(gram)
    spread = np.sqrt(np.maximum(np.einsum("mpp->mp", xx), 0.0))
    raw = np.sqrt(np.maximum(np.einsum("mpp->mp", gram)[:, 1:-1], 1e-300))
    unit = np.where(spread > 1e-7 * raw, spread, np.inf)
    scaled = xx / (unit[:, :, None] * unit[:, None, :])
    beta = np.einsum("mpq,mq->mp", np.linalg.pinv(scaled, rcond=1e-10, hermitian=True), xy / unit) / unit
    return beta, y_mean - (beta * x_mean).sum(axis=1)


def solve_models(
    grams: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    model_features: Mapping[str, Sequence[str]],
    alpha: float | None,
) -> DataFrame:
    """(keys, model, intercept, coefficients, gap) for each row of ``gram_by_group``.

    Each model uses its own part of the features; ``alpha`` None means least
    squares, a number the lasso penalty. ``gap`` is the duality gap of a lasso,
    null for least squares.
    """
    keys, features = list(keys), list(features)
    size = len(features) + 2
    upper = np.triu_indices(size)
    places = {
        model: np.array([0, *[features.index(c) + 1 for c in chosen], size - 1])
        for model, chosen in model_features.items()
    }

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for model, rows in batch.groupby("model", sort=False):
                full = np.zeros((len(rows), size, size))
                full[:, upper[0], upper[1]] = np.stack(rows["gram"].to_numpy())
                full = full + np.triu(full, 1).transpose(0, 2, 1)
                part = full[:, places[model][:, None], places[model]]
                counts = rows["rows"].to_numpy()
                if alpha is None:
                    (beta, intercept), gap = solve_ols(part), np.nan
                else:
                    beta, intercept, gap = solve_lasso(part, counts, alpha)
                yield rows[keys].assign(model=model, intercept=intercept, coefficients=list(beta), gap=gap)

    fields = [grams.schema[c] for c in keys]
    fields += [
        T.StructField("model", T.StringType()),
        T.StructField("intercept", T.DoubleType()),
        T.StructField("coefficients", T.ArrayType(T.DoubleType())),
        T.StructField("gap", T.DoubleType()),
    ]
    return grams.select(*keys, "model", "rows", "gram").mapInPandas(solve, T.StructType(fields))


def fit_by_group(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    target: str,
    alpha: float | None = None,
    weight: str | None = None,
) -> DataFrame:
    """One model per group: (keys, intercept, coefficients, gap)."""
    grams = gram_by_group(df, keys, features, target, {"model": weight})
    return solve_models(grams, keys, features, {"model": features}, alpha).drop("model")


def linear_predictor(features: Sequence[str], coefficients: Column, intercept: Column) -> Column:
    """intercept + sum of feature x coefficient, as one JVM expression."""
    values = F.array(*[F.col(quoted(c)).cast("double") for c in features])
    products = F.zip_with(values, coefficients, lambda x, b: x * b)
    return intercept + F.aggregate(products, F.lit(0.0), lambda total, v: total + v)


def predict_by_group(
    df: DataFrame,
    coefficients: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    target: str | None = None,
    prefix: str = "",
) -> DataFrame:
    """Add ``<prefix>prediction`` and, with a target, ``<prefix>residual``."""
    side = coefficients.select(
        *keys, F.col("coefficients").alias("_coefficients"), F.col("intercept").alias("_intercept")
    )
    predicted = linear_predictor(features, F.col("_coefficients"), F.col("_intercept"))
    made = df.join(side, list(keys)).withColumn(f"{prefix}prediction", predicted)
    if target is not None:
        made = made.withColumn(f"{prefix}residual", F.col(target) - F.col(f"{prefix}prediction"))
    return made.drop("_coefficients", "_intercept")


def coefficients_long(coefficients: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keys, variable, value), one row per feature."""
    names = F.array(*[F.lit(c) for c in features])
    return coefficients.select(
        *keys, F.explode(F.arrays_zip(names.alias("variable"), F.col("coefficients").alias("value"))).alias("_c")
    ).select(*keys, F.col("_c.variable").alias("variable"), F.col("_c.value").alias("value"))


def unused_features(long: DataFrame) -> DataFrame:
    """Names of features that have coefficient 0 in some group."""
    return long.where(F.col("value") == 0).select("variable").distinct()
