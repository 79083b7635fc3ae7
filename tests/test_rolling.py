"""Rolling fits from cumulative sums against fits of copied rows; the lasso against all stationary points."""

from datetime import date
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillweave.operators import regression, rolling
from tillweave.plans import backtest

TRAIN, TEST = 40, 10


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(9)
    days = pd.date_range("2020-01-01", periods=95).date
    rows = []
    for store in ("a", "b"):
        for i, day in enumerate(days):
            if (store, i % 11) != ("b", 3):  # gaps in one store
                x, z = map(float, rng.normal(size=2))
                rows.append((day, store, x, z, 5 + 2 * x - z + 0.1 * i + float(rng.normal()), i))
    return spark.createDataFrame(rows, "date date, store string, x double, z double, y double, trend int")


@pytest.fixture(scope="module")
def windows(spark, panel):
    splits = backtest.Splits(F.date_add(F.lit(date(2020, 1, 1)), TRAIN), F.lit(date(2020, 4, 4)), TRAIN, TEST)
    days = backtest.split_windows(panel.select("date", "trend").distinct(), splits)
    known = days.withColumns(
        {"set_first_date": splits.first_date(F.col("set_index")), "own": F.sin(F.col("trend") * (F.col("set_index") + 1)), "w": 1.0 / (1 + F.col("trend"))}
    )
    return splits, rolling.collect_windows(known, ["own", "w"], TRAIN, TEST), known


def test_grams_equal_those_of_copied_rows(panel, windows):
    splits, table, known = windows
    got = rolling.window_grams(panel, ["store"], ["x", "z"], "y", table, ["own"], {"plain": None, "weighted": "w"})
    copied = backtest.rolling_splits(panel, splits).where("set_type = 'train'").join(known.select("set_index", "date", "own", "w"), ["set_index", "date"])
    want = regression.gram_by_group(copied, ["set_index", "store"], ["own", "x", "z"], "y", {"plain": None, "weighted": "w"})
    key = ["set_index", "store", "model"]
    one, two = ({tuple(r[k] for k in key): r for r in df.collect()} for df in (got, want))
    assert set(one) == set(two) and len(one) == 5 * 2 * 2
    for k in one:
        assert one[k]["rows"] == two[k]["rows"]
        assert one[k]["gram"] == pytest.approx(two[k]["gram"], rel=1e-9, abs=1e-9)


def test_predictions_of_every_window(panel, windows):
    splits, table, known = windows
    grams = rolling.window_grams(panel, ["store"], ["x", "z"], "y", table, ["own"], {"m": None})
    fits = regression.solve_models(grams, ["set_index", "store"], ["own", "x", "z"], {"m": ["own", "z"]}, None)
    rows = rolling.window_predictions(panel, fits, ["store"], ["x", "z"], "y", table, ["own"], {"m": ["own", "z"]}, 7).toPandas()
    copied = backtest.rolling_splits(panel, splits).join(known.select("set_index", "date", "own"), ["set_index", "date"])
    want = regression.predict_by_group(copied, fits, ["set_index", "store"], ["own", "z"], "y").toPandas()
    both = rows.merge(want, on=["set_index", "store", "date", "set_type"], suffixes=("", "_want"))
    assert len(both) == len(rows) == len(want)
    assert np.abs(both["m_prediction"] - both["prediction"]).max() < 1e-9
    assert (both["set_first_date"] == both["set_first_date_want"]).all()
    one = rows[(rows.store == "a") & (rows.set_index == 1) & (rows.set_type == "train")].sort_values("date")
    plain = one.set_index(pd.to_datetime(one["date"]))["y"].rolling("7D").std().bfill()
    assert one["rolling_row_std"].to_numpy() == pytest.approx(plain.to_numpy(), rel=1e-9)


def test_weighted_median_of_days(spark, panel, windows):
    splits, _, _ = windows
    rows = panel.select("date", "trend")
    counted = rows.groupBy("date", "trend").agg(F.count(F.lit(1)).alias("rows"))
    one = backtest.trend_midpoints(backtest.split_windows(rows, splits)).collect()
    two = backtest.trend_midpoints(backtest.split_windows(counted, splits, "rows"), "rows").collect()
    assert sorted(one) == sorted(two)


def _least(xx, xy, penalty):
    """The lasso by trying every choice of signs."""
    best, found = 0.0, np.zeros(len(xy))
    for signs in product((-1, 0, 1), repeat=len(xy)):
        s = np.array(signs)
        used = s != 0
        if used.any():
            b = np.zeros(len(xy))
            b[used] = np.linalg.lstsq(xx[np.ix_(used, used)], xy[used] - (penalty * s)[used], rcond=None)[0]
            value = 0.5 * b @ xx @ b - b @ xy + penalty @ np.abs(b)
            if (b * s >= -1e-12).all() and value < best - 1e-15:
                best, found = value, b
    return best, found


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("strength", [1e-6, 0.05, 0.4, 5.0])
def test_lasso_is_the_least_of_all_signs(seed, strength):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, 5))
    if seed % 2:
        x[:, 4] = x[:, 0] + x[:, 1]  # dependent columns
        x[:, 3] = x[:, 2]
    x = x / np.linalg.norm(x, axis=0)
    y = x @ np.array([3.0, -2, 0, 0, 1]) + 0.1 * rng.normal(size=40)
    xx, xy, penalty = x.T @ x, x.T @ y, np.full(5, strength) * (1 + np.arange(5) / 10)
    beta, gap = regression.lasso_by_active_set(xx, xy, float(y @ y), penalty)
    value = 0.5 * beta @ xx @ beta - beta @ xy + penalty @ np.abs(beta)
    best, _ = _least(xx, xy, penalty)
    assert value == pytest.approx(best, abs=1e-9) and 0 <= gap < 1e-9
    _, screened = regression.duality_gap(xx, xy, float(y @ y), penalty, beta)
    assert (beta[screened] == 0).all()


def test_collinear_indicators_are_fitted_to_the_end(spark):
    rng = np.random.default_rng(4)
    day = rng.integers(0, 7, 500)
    x = np.column_stack([np.eye(7)[day], rng.normal(size=500)])
    y = 1000 + x @ np.array([5.0, 9, -3, 0, 0, 4, 80, 20]) + rng.normal(size=500)
    z = np.column_stack([np.ones(500), x, y])
    beta, intercept, gap = regression.solve_lasso((z.T @ z)[None], np.array([500]), 1e-4)
    assert gap[0] <= regression.GAP_TOLERANCE * y.var()
    residual = y - intercept[0] - x @ beta[0]
    gradient = x.T @ residual / 500
    live = beta[0] != 0
    assert np.abs(gradient[live] - 1e-4 * np.sign(beta[0][live])).max() < 1e-8 and (np.abs(gradient) <= 1e-4 + 1e-8).all()
    assert 0 < live.sum() < 8  # seven indicators and a level can't all be used


def test_backtest_job_on_zones(spark, data_dir):
    from tillweave.catalog.pipelines import built_zones
    from tillweave.plans import runner
    from tillweave.sources.zones import read_latest

    root, _ = built_zones(spark, data_dir)
    written = runner.build_backtest(spark, root)
    counts = {r["data_set"]: r["rows"] for r in runner.row_counts(spark, root, written).collect()}
    assert set(counts) == {name for _, name in runner.BACKTEST_SETS} and all(counts.values())
    predicted = read_latest(spark, root, "4.processed", "backtest_predictions")
    assert predicted.columns == backtest.BACKTEST_COLUMNS and predicted.count() == counts["backtest_predictions"]
    errors = read_latest(spark, root, "4.processed", "backtest_metrics")
    # The level is free of penalty, so predictions of the training rows add up to the sales.
    train = errors.where("set_type = 'train'")
    assert train.count() > 0 and train.where("abs(lasso_bias - 1) > 1e-6").count() == 0
