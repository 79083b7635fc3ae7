"""Properties of fits and of operators that have two ways."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillweave.operators import mixture, regression, series
from tillweave.operators.quantiles import exact_quantiles
from tillweave.operators.summaries import grouped_quantiles


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 1, 400), rng.normal(8, 2, 300), rng.normal(20, 1, 300)]).round(2)
    return spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(x)], "g int, x double")


def test_mixture_ways_agree(values):
    small = mixture.fit_mixture(values, "x", 3)
    large = mixture.fit_mixture(values, "x", 3, small_group=0)
    assert small.means == sorted(small.means)
    assert small.means == pytest.approx([0, 8, 20], abs=0.5)
    assert large.means == pytest.approx(small.means, rel=1e-6)
    assert large.variances == pytest.approx(small.variances, rel=1e-6)
    assert large.rounds == small.rounds


def test_grouped_mixtures_agree(values):
    def table(**options):
        rows = mixture.fit_mixtures(values, "x", 3, ["g"], **options).orderBy("g").collect()
        return [(r["g"], r["means"], r["weights"]) for r in rows]

    for a, b in zip(table(), table(small_group=0), strict=True):
        assert a[0] == b[0]
        assert a[1] == pytest.approx(b[1], rel=1e-6)
        assert a[2] == pytest.approx(b[2], rel=1e-6)


def test_large_and_small_groups_fit_side_by_side(spark):
    """One group beyond a task's values, with far more distinct ones than 20,000, and others: each as if alone."""
    rng = np.random.default_rng(8)
    wide = np.concatenate([rng.normal(0, 1, 15_000), rng.normal(9, 2, 15_000)])
    rows = [("wide", float(v)) for v in wide] + [("few", float(v)) for v in rng.integers(0, 40, 500)] + [(None, float(v)) for v in range(30)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    mixed = {r["g"]: r for r in mixture.fit_mixtures(df, "x", 2, ["g"]).collect()}
    alone = {r["g"]: r for r in mixture.fit_mixtures(df, "x", 2, ["g"], small_group=10**6).collect()}
    assert set(mixed) == {"wide", "few", None} == set(alone)
    for g in mixed:
        assert mixed[g]["rounds"] == alone[g]["rounds"] and mixed[g]["converged"] and alone[g]["converged"]
        for part in ("means", "variances", "weights"):
            assert mixed[g][part] == pytest.approx(alone[g][part], rel=1e-8)
    assert mixed["wide"]["means"] == pytest.approx([0, 9], abs=0.1)


def test_unfinished_fits_say_so(values):
    assert not mixture.fit_mixture(values, "x", 3, tolerance=0.0, max_rounds=3).converged
    assert not mixture.fit_mixture(values, "x", 3, tolerance=0.0, max_rounds=3, small_group=0).converged


def test_memberships_sum_to_one(values):
    scored = mixture.mixture_memberships(values, "x", 3, cluster=True)
    total = sum((F.col(f"x_guassian_splines.x_{k}") for k in (1, 2, 3)), F.lit(0.0))
    assert scored.agg(F.max(F.abs(total - 1))).first()[0] < 1e-12
    labels = scored.groupBy("x_cluster").agg(F.avg("x").alias("m")).orderBy("x_cluster").collect()
    assert [r["x_cluster"] for r in labels] == [0, 1, 2]
    assert [r["m"] for r in labels] == sorted(r["m"] for r in labels)


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(3)
    n = 600
    x = rng.normal(size=(n, 4))
    day = rng.integers(0, 3, n)
    hot = np.eye(3)[day]
    y = 5 + x @ np.array([3.0, 0.0, -2.0, 0.0]) + hot @ np.array([1.0, 0.0, -1.0]) + rng.normal(size=n) * 0.1
    w = rng.random(n) + 0.1
    rows = [(int(i % 3), *map(float, x[i]), *map(float, hot[i]), float(y[i]), float(w[i])) for i in range(n)]
    names = ["a", "b", "c", "d", "h0", "h1", "h2"]
    schema = "g int, " + ", ".join(f"{c} double" for c in [*names, "y", "w"])
    return spark.createDataFrame(rows, schema).repartition(5), names


@pytest.mark.parametrize("weight", [None, "w"])
def test_lasso_meets_its_conditions(design, weight):
    df, names = design
    alpha = 0.05
    fits = {r["g"]: r for r in regression.fit_by_group(df, ["g"], names, "y", alpha, weight).collect()}
    for g, rows in df.toPandas().groupby("g"):
        x, y = rows[names].to_numpy(), rows["y"].to_numpy()
        w = rows["w"].to_numpy() if weight else np.ones(len(rows))
        beta = np.array(fits[g]["coefficients"])
        residual = y - fits[g]["intercept"] - x @ beta
        gradient = x.T @ (w * residual) / len(rows)
        assert abs((w * residual).sum()) < 1e-6
        live = beta != 0
        assert gradient[live] == pytest.approx(alpha * np.sign(beta[live]), abs=1e-5)
        assert (np.abs(gradient[~live]) <= alpha + 1e-5).all()
        assert not live[1] and not live[3]


def test_least_squares_is_orthogonal_and_predicts(design):
    df, names = design
    fitted = regression.fit_by_group(df, ["g"], names, "y", weight="w")
    rows = regression.predict_by_group(df, fitted, ["g"], names, "y").toPandas()
    for _, part in rows.groupby("g"):
        wr = part["w"] * part["residual"]
        assert np.abs(part[names].to_numpy().T @ wr.to_numpy()).max() < 1e-6
        assert np.abs(part["y"] - part["prediction"] - part["residual"]).max() < 1e-12


def test_exact_quantiles_need_no_gathering(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=30_000), np.zeros(15_000)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(6)
    ordered = np.sort(x)
    for p in (0.01, 0.5, 0.99):
        expected = ordered[int(np.ceil(p * len(x) - 1e-9)) - 1]
        assert exact_quantiles(df, "x", [p], accuracy=20) == [expected]
        assert exact_quantiles(df, "x", [p]) == [expected]


def test_grouped_quantiles_match(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i % 4), int(v)) for i, v in enumerate(rng.integers(0, 50, 2000))]
    df = spark.createDataFrame(rows, "g int, v int")
    got = {r["g"]: r["q"] for r in grouped_quantiles(df, ["g"], "v", {"q": 0.3}).collect()}
    for g in range(4):
        ordered = sorted(v for k, v in rows if k == g)
        assert got[g] == ordered[int(np.ceil(0.3 * len(ordered))) - 1]


def _brute_entropy(x, m, r):
    def phi(size):
        windows = [x[i : i + size] for i in range(len(x) - size + 1)]
        shares = [
            sum(max(abs(a - b) for a, b in zip(u, v)) <= r for v in windows) / len(windows) for u in windows
        ]
        return sum(np.log(shares)) / len(windows)

    return abs(phi(m) - phi(m + 1))


@pytest.mark.parametrize(("kind", "level"), [("int", 0.0001), ("int", 0.8), ("double", 0.3)])
def test_approximate_entropy(spark, kind, level):
    rng = np.random.default_rng(4)
    data = {k: [int(v) for v in rng.integers(0, 4, 60)] for k in ("a", "b")}
    rows = [(k, i, v) for k, vs in data.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "id string, date int, sales int").withColumn("sales", F.col("sales").cast(kind))
    got = {r["id"]: r["approximate_entropy"] for r in series.approximate_entropy(df, 2, level).collect()}
    for k, vs in data.items():
        assert got[k] == pytest.approx(_brute_entropy(vs, 2, level * np.std(vs)), abs=1e-9)


def test_wide_tolerance_of_a_long_series_equals_brute_force(spark):
    """Two thousand days of fractions, of equal values and with a gap; no series is handed to one task."""
    rng = np.random.default_rng(8)
    wave = [float(v) for v in np.sin(np.arange(2000) / 9) + rng.normal(0, 0.3, 2000)]
    rows = [("wave", d, v) for d, v in enumerate(wave)] + [("flat", d, 2.5) for d in range(300)]
    rows += [("gap", d, float("nan") if d == 7 else 0.5 * d) for d in range(30)] + [("short", 0, 1.0)]
    df = spark.createDataFrame(rows, "id string, date int, sales double")
    out = series.approximate_entropy(df, 3, 0.2)
    got = {r["id"]: r["approximate_entropy"] for r in out.collect()}
    tolerance, known = 0.2 * np.std(wave), []
    for size in (3, 4):
        windows = np.lib.stride_tricks.sliding_window_view(np.array(wave), size)
        shares = [np.mean(np.abs(windows - w).max(axis=1) <= tolerance) for w in windows]
        known.append(np.mean(np.log(shares)))
    assert got["wave"] == pytest.approx(abs(known[0] - known[1]), abs=1e-9)
    assert got["flat"] == pytest.approx(0) and got["gap"] is None and got["short"] is None
    assert "InPandas" not in out._jdf.queryExecution().toString()


def test_deseasonalize_removes_its_own_wave(spark):
    t = np.arange(140)
    rows = [("a", int(i), float(10 + 3 * np.sin(2 * np.pi * i / 7))) for i in t]
    df = spark.createDataFrame(rows, "id string, date int, sales double")
    flat = series.deseasonalize_fourier(df, 7, 3)
    assert flat.agg(F.stddev_samp("sales")).first()[0] < 1e-9
    assert flat.agg(F.avg("sales")).first()[0] == pytest.approx(10)


def test_spectral_entropy_tells_noise_from_waves(spark):
    rng = np.random.default_rng(5)
    rows = [("noise", i, float(v)) for i, v in enumerate(rng.normal(size=400))]
    rows += [("wave", i, float(np.sin(i) + 0.01 * v)) for i, v in enumerate(rng.normal(size=400))]
    rows += [("flat", i, 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "id string, date int, sales double")
    got = {r["id"]: r["spectral_entropy"] for r in series.spectral_ar_entropy(df).collect()}
    assert got["noise"] > 0.9
    assert got["wave"] < got["noise"] - 0.2
    assert got["flat"] is None


def test_quantiles_of_few_values_need_no_sort(spark):
    df = spark.createDataFrame([(float(i % 2), None if i else 3) for i in range(1000)], "x double, y int")
    assert exact_quantiles(df, "x", [0.0, 0.5, 0.501, 1.0], accuracy=10) == [0.0, 0.0, 1.0, 1.0]
    assert exact_quantiles(df, "y", [0.5]) == [3]
    assert exact_quantiles(df.where("x > 5"), "x", [0.5]) == [None]


def test_grouped_quantiles_of_many_values(spark):
    from tillweave.operators.summaries import grouped_quantiles

    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rng.normal(size=5000)] + [(None, float(i)) for i in range(7)] + [("b", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: (r["lo"], r["mid"], r["hi"]) for r in grouped_quantiles(df, ["g"], "x", {"lo": 0.0, "mid": 0.37, "hi": 1.0}).collect()}
    a = np.sort([v for g, v in rows if g == "a"])
    assert got == {"a": (a[0], a[int(np.ceil(0.37 * 5000)) - 1], a[-1]), None: (0.0, 2.0, 6.0)}


def test_backward_fill_is_linear_and_right(spark):
    from tillweave.operators.nulls import fill_backward

    df = spark.createDataFrame([("a", d, v) for d, v in enumerate([None, 1, None, None, 2, None])], "id string, date int, v int")
    filled = df.withColumn("f", fill_backward(F.col("v"), "id", "date"))
    assert [r["f"] for r in filled.orderBy("date").collect()] == [1, 1, 2, 2, 2, None]
    assert "unboundedfollowing" not in filled._jdf.queryExecution().toString().lower().replace(" ", "")


def test_a_missing_weight_concerns_its_own_model(spark):
    rows = [("g", float(i), 2.0 * i + 1, None if i == 0 else 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "g string, x double, y double, w double")
    grams = regression.gram_by_group(df, ["g"], ["x"], "y", {"plain": None, "weighted": "w"})
    assert {r["model"]: r["rows"] for r in grams.collect()} == {"plain": 4, "weighted": 3}


def test_short_series_keep_their_row(spark):
    from tillweave.operators.series import approximate_entropy

    days = [("long", d, d % 3) for d in range(30)] + [("short", d, d) for d in range(3)] + [("empty", d, None) for d in range(30)]
    df = spark.createDataFrame(days, "id string, date int, sales int")
    got = {r[0]: r[1] for r in approximate_entropy(df).collect()}
    assert got["long"] is not None and got["short"] is None and got["empty"] is None


def test_factorial_of_large_numbers(spark):
    from tillweave.functions.maths import factorial

    got = spark.range(26).select(factorial(F.col("id").cast("int"))).collect()
    for n, (value,) in enumerate(got):
        assert abs(value / float(np.prod(np.arange(1, n + 1, dtype=float))) - 1) < 1e-9


def test_text_is_taken_literally(spark):
    from tillweave.functions.text import strip_prefix, take_parts

    df = spark.createDataFrame([("a.b-c", "x^y]z")], "p string, q string")
    row = df.select(strip_prefix(F.col("p"), "a.b"), strip_prefix(F.col("p"), "a-b"), take_parts(F.col("q"), [1], "^"), take_parts(F.col("q"), [0], "]")).first()
    assert tuple(row) == ("-c", "a.b-c", "y]z", "x^y")


def test_sketches_of_days_make_those_of_periods(spark):
    from tillweave.operators import sketches

    rng = np.random.default_rng(6)
    rows = [(int(d), int(v)) for d in range(10) for v in rng.integers(0, 30_000, 4000)] + [(0, None)]
    df = spark.createDataFrame(rows, "day int, v int")
    daily = sketches.distinct_sketches(df, ["day"], "v")
    half = F.floor(F.col("day") / 5).alias("half")
    got = {r["half"]: r["estimate"] for r in sketches.rolled_up(daily, half).collect()}
    once = {r["half"]: r["estimate"] for r in sketches.rolled_up(sketches.distinct_sketches(df.select(half, "v"), ["half"], "v"), F.col("half")).collect()}
    for h in (0, 1):
        exact = len({v for d, v in rows if d // 5 == h and v is not None})
        assert abs(got[h] - exact) <= 3 * 1.04 / 128 * exact and abs(once[h] - exact) <= 3 * 1.04 / 128 * exact
    assert sketches.rolled_up(daily).count() == 1


def _plain_spectral_entropy(x, max_lag):
    """Order by least squares on the lagged values themselves, one order after the other."""
    from tillweave.operators import series

    n = len(x)
    top = min(max_lag, max(n // 2 - 1, 0))
    target = x[top:]
    lags = np.column_stack([x[top - k : n - k] for k in range(1, top + 1)]) if top else np.empty((n, 0))
    best, order = np.inf, 0
    for p in range(top + 1):
        fit = np.linalg.lstsq(lags[:, :p], target, rcond=None)[0] if p else np.zeros(0)
        aic = len(target) * np.log(max(float(((target - lags[:, :p] @ fit) ** 2).mean()), 1e-300)) + 2 * (p + 1)
        if aic < best - 1e-12:
            best, order = aic, p
    y = x[order:]
    own = np.column_stack([np.ones(len(y)), *[x[order - k : n - k] for k in range(1, order + 1)]])
    fit = np.linalg.lstsq(own, y, rcond=None)[0]
    return series._spectral_entropy(fit[1:], float(((y - own @ fit) ** 2).mean()), n)


def test_spectral_entropy_equals_least_squares_per_series(spark):
    rng = np.random.default_rng(11)
    data = {"noise": rng.normal(5, 1, 300), "short": rng.normal(size=9), "four": rng.normal(size=4), "whole": rng.integers(0, 50, 200).astype(float)}
    walk = np.zeros(250)
    for t in range(3, 250):
        walk[t] = 0.6 * walk[t - 1] - 0.3 * walk[t - 3] + rng.normal()
    data["walk"] = walk + 10
    rows = [(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)] + [("gap", i, None if i == 5 else float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, date int, sales double")
    got = {r["id"]: r["spectral_entropy"] for r in series.spectral_ar_entropy(df).collect()}
    assert got.pop("gap") is None
    assert got == {k: pytest.approx(_plain_spectral_entropy(x, 25), abs=1e-8) for k, x in data.items()}
