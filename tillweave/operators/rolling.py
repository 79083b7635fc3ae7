"""Regressions over many overlapping training windows, from cumulative sums of products.

A series is read once, whatever the number of windows. The products of its rows are summed between the days on which
some window begins or ends, and added up; the matrix of a window is then the difference of two of these sums. Columns
that depend on window and date, such as regimes fitted anew in every window, and weights of their own are attached by
date. No row is copied for a window before it is predicted.

A group holds one series: a row per date, or few, so that it is as long as the calendar. What depends on window and
date alone is given to every task; its size, windows x days x columns, grows with the calendar and not with the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.operators.relational import quoted

DAY = "_day"


@dataclass(frozen=True)
class Windows:
    """Windows in days since 1970-01-01, the test after the training, and per window a matrix of its own columns.

    Row i of a matrix belongs to the i-th day of the window; days without values are NaN.
    """

    index: list[int]
    train_start: np.ndarray
    test_start: np.ndarray
    test_end: np.ndarray
    columns: list[str]
    values: list[np.ndarray]


def collect_windows(
    known: DataFrame, columns: Sequence[str], train_days: int, test_days: int, date_col: str = "date"
) -> Windows:
    """Windows from rows (set_index, set_first_date, date, columns): one per window and date."""
    columns = list(columns)
    table = known.select(
        "set_index", F.unix_date("set_first_date").alias("_first"), F.unix_date(date_col).alias(DAY),
        *[F.col(quoted(c)).cast("double").alias(c) for c in columns],
    ).toPandas()
    index, starts, values = [], [], []
    for (number, first), rows in table.groupby(["set_index", "_first"], sort=True):
        own = np.full((train_days + test_days, len(columns)), np.nan)
        place = rows[DAY].to_numpy() - (first - train_days)
        inside = (place >= 0) & (place < len(own))
        own[place[inside]] = rows[columns].to_numpy(dtype=float)[inside]
        index.append(int(number))
        starts.append(int(first))
        values.append(own)
    first = np.array(starts, np.int64)
    return Windows(index, first - train_days, first, first + test_days, columns, values)


def _upper(matrix: np.ndarray) -> np.ndarray:
    return matrix[np.triu_indices(len(matrix))]


def series_grams(
    day: np.ndarray, z: np.ndarray, windows: Windows, own: Sequence[int], weights: Mapping[str, int | None]
) -> list[tuple[int, str, int, np.ndarray]]:
    """(window, model, rows, matrix) of one series sorted by day; z is [1, features, target].

    ``own`` are the places of a window's columns that are features, put after the 1; ``weights`` gives the place of
    each model's weight, None for equal ones.
    """
    size, k = z.shape[1], len(own)
    others = np.array([0, *range(k + 1, k + size)])
    cuts = np.unique(np.concatenate([windows.train_start, windows.test_start]))
    at = np.searchsorted(day, cuts)
    sums = np.zeros((len(cuts), size, size))
    for i in range(1, len(cuts)):
        part = z[at[i - 1] : at[i]]
        sums[i] = sums[i - 1] + part.T @ part
    out = []
    for w, number in enumerate(windows.index):
        first, last = np.searchsorted(cuts, [windows.train_start[w], windows.test_start[w]])
        lo, hi = at[first], at[last]
        values = windows.values[w][day[lo:hi] - windows.train_start[w]]
        mine, rows = values[:, list(own)], z[lo:hi]
        held = ~np.isnan(mine).any(axis=1)
        whole = bool(held.all())
        if not whole:
            mine, rows, values = mine[held], rows[held], values[held]
        if not len(rows):
            continue
        for model, place in weights.items():
            full = np.empty((size + k, size + k))
            if place is None:
                weighed = mine
                full[np.ix_(others, others)] = sums[last] - sums[first] if whole else rows.T @ rows
            else:
                weight = np.nan_to_num(values[:, place])[:, None]
                weighed = mine * weight
                full[np.ix_(others, others)] = rows.T @ (rows * weight)
            cross = weighed.T @ rows
            full[1 : k + 1, others], full[np.ix_(others, range(1, k + 1))] = cross, cross.T
            full[1 : k + 1, 1 : k + 1] = weighed.T @ mine
            out.append((number, model, len(rows), full))
    return out


def window_grams(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    target: str,
    windows: Windows,
    own: Sequence[str],
    weights: Mapping[str, str | None],
    date_col: str = "date",
) -> DataFrame:
    """Sums of products per training window and group, for ``solve_models``: (set_index, keys, model, rows, gram).

    The order of the features is ``own``, then ``features``. A row counts if its features, its target and the window's
    own columns are there; a missing weight is 0.
    """
    keys, features = list(keys), list(features)
    places = [windows.columns.index(c) for c in own]
    weight_places = {m: None if c is None else windows.columns.index(c) for m, c in weights.items()}

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[*features, target]).sort_values(DAY)
        z = np.column_stack([np.ones(len(pdf)), pdf[[*features, target]].to_numpy(dtype=float)])
        found = series_grams(pdf[DAY].to_numpy(), z, windows, places, weight_places)
        rows = [(number, *key, model, held, _upper(gram)) for number, model, held, gram in found]
        return pd.DataFrame(rows, columns=["set_index", *keys, "model", "rows", "gram"])

    fields = [T.StructField("set_index", T.IntegerType()), *[df.schema[c] for c in keys]]
    fields += [
        T.StructField("model", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("gram", T.ArrayType(T.DoubleType())),
    ]
    rows = df.select(*keys, F.unix_date(date_col).alias(DAY), *[F.col(quoted(c)) for c in [*features, target]])
    return rows.groupBy(*keys).applyInPandas(one, T.StructType(fields))


def trailing_std(day: np.ndarray, y: np.ndarray, days: int) -> np.ndarray:
    """Sample std of the values of the last ``days`` days, gaps at the start filled from the next one."""
    lo, hi = np.searchsorted(day, day - (days - 1)), np.searchsorted(day, day, side="right")
    one, two = np.concatenate([[0.0], np.cumsum(y)]), np.concatenate([[0.0], np.cumsum(y * y)])
    n = (hi - lo).astype(float)
    with np.errstate(invalid="ignore", divide="ignore"):
        # Whole numbers give exact sums here, so equal values have no spread.
        square = (n * (two[hi] - two[lo]) - (one[hi] - one[lo]) ** 2) / (n * (n - 1.0))
    return pd.Series(np.sqrt(np.maximum(square, 0.0))).bfill().to_numpy()


def window_predictions(
    df: DataFrame,
    coefficients: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    target: str,
    windows: Windows,
    own: Sequence[str],
    model_features: Mapping[str, Sequence[str]],
    std_days: int = 30,
    date_col: str = "date",
) -> DataFrame:
    """Train and test rows of every window with the predictions and residuals of all models.

    Columns: date, keys, set_index, set_type, set_first_date, target, rolling_row_std, then prediction and residual of
    each model. Windows without a model, or rows without a feature, have null there. The trailing std starts anew in
    every set.
    """
    keys, features, own = list(keys), list(features), list(own)
    order = [*own, *features]
    chosen = {model: np.array([order.index(c) for c in names]) for model, names in model_features.items()}
    places = [windows.columns.index(c) for c in own]
    result = [f"{m}_{part}" for m in chosen for part in ("prediction", "residual")]
    columns = ["date", *keys, "set_index", "set_type", "set_first_date", target, "rolling_row_std", *result]

    def both(key: tuple, rows: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(DAY)
        day, y = rows[DAY].to_numpy(), rows[target].to_numpy(dtype=float)
        x = rows[features].to_numpy(dtype=float)
        known = {(r["set_index"], r["model"]): r for r in fits.to_dict("records")}
        parts = []
        for w, number in enumerate(windows.index):
            for kind, first, last in (
                ("train", windows.train_start[w], windows.test_start[w]),
                ("pred", windows.test_start[w], windows.test_end[w]),
            ):
                lo, hi = np.searchsorted(day, [first, last])
                if lo == hi:
                    continue
                part = {DAY: day[lo:hi], "set_index": number, "set_type": kind, "_first": windows.test_start[w], target: rows[target].iloc[lo:hi]}
                part["rolling_row_std"] = trailing_std(day[lo:hi], y[lo:hi], std_days)
                wide = np.column_stack([windows.values[w][day[lo:hi] - windows.train_start[w]][:, places], x[lo:hi]])
                for model, used in chosen.items():
                    fit = known.get((number, model))
                    made = np.full(hi - lo, np.nan)
                    if fit is not None:
                        made = fit["intercept"] + wide[:, used] @ np.asarray(fit["coefficients"], float)
                    part[f"{model}_prediction"], part[f"{model}_residual"] = made, y[lo:hi] - made
                parts.append(pd.DataFrame(part))
        names = [DAY, "set_index", "set_type", "_first", target, "rolling_row_std", *result]
        out = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=names)
        for name, value in zip(keys, key):
            out[name] = value
        return out[[DAY, *keys, "set_index", "set_type", "_first", target, "rolling_row_std", *result]]

    fields = [T.StructField(DAY, T.IntegerType()), *[df.schema[c] for c in keys]]
    fields += [T.StructField("set_index", T.IntegerType()), T.StructField("set_type", T.StringType())]
    fields += [T.StructField("_first", T.IntegerType()), df.schema[target], T.StructField("rolling_row_std", T.DoubleType())]
    fields += [T.StructField(c, T.DoubleType()) for c in result]
    rows = df.select(*keys, F.unix_date(date_col).alias(DAY), *[F.col(quoted(c)) for c in [*features, target]])
    fits = coefficients.select(*keys, "set_index", "model", "intercept", "coefficients")
    made = rows.groupBy(*keys).cogroup(fits.groupBy(*keys)).applyInPandas(both, T.StructType(fields))
    return made.withColumns(
        {date_col: F.date_from_unix_date(DAY), "set_first_date": F.date_from_unix_date("_first")}
    ).select(*[date_col if c == "date" else c for c in columns])
