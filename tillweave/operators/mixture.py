"""One-dimensional Gaussian mixtures, fitted by Spark aggregates.

A fit reads the data once, into counts per distinct value. A round of Lloyd or EM adds up moments per group and
component, which merge from partial sums. A task that holds all distinct values of a group does its rounds there; a
group with more than ``TASK_VALUES`` of them is never gathered, and its rounds are one aggregation each, with one short
row per group after the shuffle. Every group takes the same steps, whatever the size of others: start means at exact
ranks of its distinct values, the same moments, the same rule to stop, and a flag that says whether it was reached.
Components are ordered by mean, so their numbers are stable.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.operators.relational import quoted
from tillweave.operators.summaries import grouped_quantiles
from tillweave.session import ensure_checkpoint_dir

# The usual defaults of EM for mixtures.
TOLERANCE = 1e-3
MAX_ROUNDS = 100
VARIANCE_FLOOR = 1e-6
LLOYD_ROUNDS = 20
# Distinct values of one group that a task holds.
TASK_VALUES = 20_000


@dataclass(frozen=True)
class Mixture:
    """Parameters of one mixture, ordered by mean."""

    weights: list[float]
    means: list[float]
    variances: list[float]
    log_likelihood: float
    rounds: int
    converged: bool


def _log_densities(x: Column, weights, means, variances) -> list[Column]:
    half_log_2pi = 0.5 * math.log(2.0 * math.pi)
    return [
        F.log(w) - F.lit(half_log_2pi) - F.lit(0.5) * F.log(v) - (x - m) * (x - m) / (F.lit(2.0) * v)
        for w, m, v in zip(weights, means, variances)
    ]


def _with_responsibilities(df: DataFrame, x: Column, weights, means, variances) -> DataFrame:
    """Adds _r1.._rk and _lse, by log-sum-exp; all in built-in expressions."""
    k = len(means)
    logs = {f"_l{j}": c for j, c in enumerate(_log_densities(x, weights, means, variances), 1)}
    names = [F.col(c) for c in logs]
    top = F.greatest(*names) if k > 1 else names[0]
    total = sum((F.exp(c - F.col("_top")) for c in names[1:]), F.exp(names[0] - F.col("_top")))
    return (
        df.withColumns(logs)
        .withColumn("_top", top)
        .withColumn("_lse", F.col("_top") + F.log(total))
        .withColumns({f"_r{j}": F.exp(F.col(f"_l{j}") - F.col("_lse")) for j in range(1, k + 1)})
        .drop("_top", *logs)
    )


def _with_nearest(df: DataFrame, x: Column, means) -> DataFrame:
    """Adds _r1.._rk as 0/1 for the nearest mean, and a zero _lse."""
    distances = {f"_d{j}": F.abs(x - m) for j, m in enumerate(means, 1)}
    names = list(distances)
    least = F.least(*[F.col(c) for c in names]) if len(names) > 1 else F.col(names[0])
    staged = df.withColumns(distances).withColumn("_least", least)
    taken = F.lit(False)
    marks = {}
    for j, c in enumerate(names, 1):
        is_least = F.col(c) == F.col("_least")
        marks[f"_r{j}"] = F.when(is_least & ~taken, 1.0).otherwise(0.0)
        taken = taken | is_least
    return staged.withColumns(marks).withColumn("_lse", F.lit(0.0)).drop("_least", *names)


def _one_round(
    histogram: DataFrame, keys: list[str], k: int, hard: bool, weights, means, variances
) -> DataFrame:
    """One pass: new parameters per group from the current ones."""
    x, n = F.col("_x"), F.col("_n")
    scored = (
        _with_nearest(histogram, x, means)
        if hard
        else _with_responsibilities(histogram, x, weights, means, variances)
    )
    sums = [F.sum(n).alias("_total"), (F.sum(n * F.col("_lse")) / F.sum(n)).alias("_ll")]
    for j in range(1, k + 1):
        # Moments about the old mean: no cancellation of large squares.
        r, gap = n * F.col(f"_r{j}"), x - means[j - 1]
        sums += [
            F.sum(r).alias(f"_n{j}"),
            F.sum(r * gap).alias(f"_a{j}"),
            F.sum(r * gap * gap).alias(f"_b{j}"),
            F.any_value(means[j - 1]).alias(f"_m{j}"),
        ]
    sums += [F.var_pop(x).alias("_spread")]
    totals = scored.groupBy(*keys).agg(*sums)

    def new(j: int, part: str) -> Column:
        size = F.col(f"_n{j}")
        used = size > 1e-12
        shift = F.col(f"_a{j}") / size
        if part == "weight":
            return F.greatest(size / F.col("_total"), F.lit(1e-300))
        if part == "mean":
            return F.when(used, F.col(f"_m{j}") + shift).otherwise(F.col(f"_m{j}"))
        variance = F.greatest(F.col(f"_b{j}") / size - shift * shift, F.lit(0.0))
        return F.when(used, variance).otherwise(F.col("_spread")) + F.lit(VARIANCE_FLOOR)

    return totals.select(
        *keys,
        *[
            F.array(*[new(j, part) for j in range(1, k + 1)]).alias(name)
            for part, name in (("weight", "weights"), ("mean", "means"), ("variance", "variances"))
        ],
        F.col("_ll").alias("ll"),
    )


def _ordered(params: DataFrame, keys: list[str]) -> DataFrame:
    zipped = F.sort_array(
        F.zip_with(
            "means",
            F.arrays_zip("weights", "variances"),
            lambda m, wv: F.struct(m.alias("m"), wv["weights"].alias("w"), wv["variances"].alias("v")),
        )
    )
    return params.withColumn("_c", zipped).select(
        *keys, F.col("_c.w").alias("weights"), F.col("_c.m").alias("means"), F.col("_c.v").alias("variances"),
        "ll", "rounds", F.col("done").alias("converged"),
    )


def _start_means(k: int) -> list[float]:
    return [(i + 0.5) / k for i in range(k)]


def _histogram(df: DataFrame, value_col: str, keys: list[str], count_col: str | None = None) -> DataFrame:
    x = F.col(quoted(value_col)).cast("double")
    n = F.count(F.lit(1)) if count_col is None else F.sum(quoted(count_col))
    return df.where(F.col(quoted(value_col)).isNotNull()).groupBy(*keys, x.alias("_x")).agg(n.cast("double").alias("_n"))


def _quantile_starts(x: np.ndarray, k: int) -> np.ndarray:
    ranks = np.ceil(np.asarray(_start_means(k)) * len(x)).astype(int)
    return x[np.clip(ranks - 1, 0, len(x) - 1)]


def _solve_counts(
    x: np.ndarray, n: np.ndarray, k: int, tolerance: float, max_rounds: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int, bool]:
    """The rounds of one group on its sorted distinct values x with counts n."""
    total, spread = n.sum(), x.var()

    def moments(r: np.ndarray, means: np.ndarray):
        gap = x[:, None] - means
        size = (n[:, None] * r).sum(axis=0)
        used = size > 1e-12
        safe = np.where(used, size, 1.0)
        shift = (n[:, None] * r * gap).sum(axis=0) / safe
        variance = np.maximum((n[:, None] * r * gap * gap).sum(axis=0) / safe - shift * shift, 0.0)
        return (
            np.maximum(size / total, 1e-300),
            np.where(used, means + shift, means),
            np.where(used, variance, spread) + VARIANCE_FLOOR,
        )

    means = _quantile_starts(x, k)
    for _ in range(LLOYD_ROUNDS):
        nearest = np.abs(x[:, None] - means).argmin(axis=1)
        weights, moved, variances = moments(np.eye(k)[nearest], means)
        gap, means = np.abs(moved - means).max(), moved
        if gap < 1e-9:
            break
    last, rounds, done = None, 0, False
    while not done and rounds < max_rounds:
        logs = np.log(weights) - 0.5 * np.log(2 * np.pi * variances)
        logs = logs - (x[:, None] - means) ** 2 / (2.0 * variances)
        top = logs.max(axis=1, keepdims=True)
        lse = top + np.log(np.exp(logs - top).sum(axis=1, keepdims=True))
        weights, means, variances = moments(np.exp(logs - lse), means)
        mean_ll = float((n * lse[:, 0]).sum() / total)
        rounds += 1
        done = last is not None and abs(mean_ll - last) < tolerance
        last = mean_ll
    order = np.argsort(means, kind="stable")
    return weights[order], means[order], variances[order], last, rounds, done


def _solve_in_tasks(
    histogram: DataFrame, keys: list[str], k: int, tolerance: float, max_rounds: int
) -> DataFrame:
    """One row (keys, weights, means, variances, ll, rounds, converged) per group."""

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_x")
        w, m, v, ll, rounds, done = _solve_counts(
            pdf["_x"].to_numpy(), pdf["_n"].to_numpy(), k, tolerance, max_rounds
        )
        row = dict(zip(keys, key)) | {"weights": [w], "means": [m], "variances": [v]}
        return pd.DataFrame(row | {"ll": ll, "rounds": rounds, "converged": done})

    fields = [histogram.schema[c] for c in keys]
    fields += [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("weights", "means", "variances")]
    fields += [T.StructField("ll", T.DoubleType()), T.StructField("rounds", T.IntegerType())]
    fields += [T.StructField("converged", T.BooleanType())]
    return histogram.groupBy(*keys).applyInPandas(solve, T.StructType(fields))


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on groups, a null group among them; the left side's keys stay."""
    own = {c: f"_key{i}" for i, c in enumerate(keys)}
    same = [F.col(quoted(c)).eqNullSafe(F.col(n)) for c, n in own.items()]
    return left.join(right.withColumnsRenamed(own), same, how).drop(*own.values())


def fit_mixture(
    df: DataFrame,
    value_col: str,
    components: int = 3,
    tolerance: float = TOLERANCE,
    max_rounds: int = MAX_ROUNDS,
    small_group: int = TASK_VALUES,
) -> Mixture:
    """Fit one mixture to a column. Only its 3k numbers reach the driver."""
    whole = df.select(F.col(quoted(value_col)).alias("_value"), F.lit(0).alias("_group"))
    row = fit_mixtures(whole, "_value", components, ["_group"], tolerance, max_rounds, small_group).first()
    if row is None:
        raise ValueError(f"no values in {value_col!r}")
    return Mixture(row["weights"], row["means"], row["variances"], row["ll"], row["rounds"], row["converged"])


def fit_mixtures(
    df: DataFrame,
    value_col: str,
    components: int,
    group_cols: Sequence[str],
    tolerance: float = TOLERANCE,
    max_rounds: int = MAX_ROUNDS,
    small_group: int = TASK_VALUES,
    count_col: str | None = None,
) -> DataFrame:
    """Fit one mixture per group, all groups in the same jobs.

    Returns (groups, weights, means, variances, ll, rounds, converged), cut
    from the lineage of the data by a checkpoint. ``converged`` is false where
    ``max_rounds`` ended a fit. A null group is a group. With ``count_col`` a
    row stands for that many.
    """
    ensure_checkpoint_dir(df.sparkSession)
    k, keys = components, list(group_cols)
    histogram = _histogram(df, value_col, keys, count_col).persist()
    try:
        sizes = histogram.groupBy(*keys).agg(F.count(F.lit(1)).alias("_values"))
        largest = sizes.agg(F.max("_values")).first()[0] or 0
        if largest <= small_group:
            return _solve_in_tasks(histogram, keys, k, tolerance, max_rounds).checkpoint()
        # Only the large groups take Spark rounds.
        large = sizes.where(F.col("_values") > small_group).select(*keys).checkpoint()
        whole = _solve_in_tasks(_join(histogram, large, keys, "left_anti"), keys, k, tolerance, max_rounds)
        spread = _fit_by_rounds(_join(histogram, large, keys, "left_semi"), keys, k, tolerance, max_rounds)
        return whole.unionByName(spread).checkpoint()
    finally:
        histogram.unpersist()


def _fit_by_rounds(histogram: DataFrame, keys: list[str], k: int, tolerance: float, max_rounds: int) -> DataFrame:
    """The parameter table is checkpointed every round, which keeps the plan
    flat and survives lost executors. A converged group keeps its parameters."""
    starts = {f"_q{j}": q for j, q in enumerate(_start_means(k))}
    start = grouped_quantiles(histogram, keys, "_x", starts)
    nothing = [F.lit(None).cast("double").alias("ll"), F.lit(0).alias("rounds"), F.lit(False).alias("done")]
    params = start.select(*keys, *_constant_parts(k), F.array(*starts).alias("means"), *nothing).checkpoint()
    for hard, limit in ((True, LLOYD_ROUNDS), (False, max_rounds)):
        params = params.withColumns({"done": F.lit(False), "ll": F.lit(None).cast("double"), "rounds": F.lit(0)})
        for _ in range(limit):
            params = _advance(histogram, params, keys, k, hard, tolerance).checkpoint()
            if params.agg(F.bool_and("done")).first()[0]:
                break
    return _ordered(params, keys)


def em_rounds(
    df: DataFrame, value_col: str, group_cols: Sequence[str], start: tuple[Sequence[float], ...], rounds: int
) -> DataFrame:
    """(groups, weights, means, variances, ll) after a number of EM rounds from given weights, means and variances."""
    keys = list(group_cols)
    histogram = _histogram(df, value_col, keys)
    k = len(start[0])
    parts = [[F.lit(float(v)) for v in part] for part in start]
    for _ in range(rounds):
        params = _one_round(histogram, keys, k, False, *parts)
        held = params.withColumnsRenamed({"weights": "_w", "means": "_m", "variances": "_v", "ll": "_ll_before"})
        histogram = _join(_histogram(df, value_col, keys), held, keys)
        parts = [[F.col(c)[j] for j in range(k)] for c in ("_w", "_m", "_v")]
    return params


def _constant_parts(k: int) -> list[Column]:
    return [
        F.array(*[F.lit(1.0 / k)] * k).alias("weights"),
        F.array(*[F.lit(1.0)] * k).alias("variances"),
    ]


def _advance(histogram, params, keys, k, hard, tolerance) -> DataFrame:
    open_groups = params.where(~F.col("done"))
    joined = _join(histogram, open_groups, keys)
    parts = [[F.col(c)[j] for j in range(k)] for c in ("weights", "means", "variances")]
    moved = _one_round(joined, keys, k, hard, *parts)
    old = open_groups.select(*keys, F.col("means").alias("_old_means"), F.col("ll").alias("_old_ll"), "rounds")
    if hard:
        gap = F.array_max(F.zip_with("means", "_old_means", lambda a, b: F.abs(a - b)))
        done = gap < 1e-9
    else:
        done = F.coalesce(F.abs(F.col("ll") - F.col("_old_ll")) < tolerance, F.lit(False))
    columns = [*keys, "weights", "variances", "means", "ll", "rounds", "done"]
    fresh = _join(moved, old, keys).withColumns({"done": done, "rounds": F.col("rounds") + 1}).select(*columns)
    return fresh.unionByName(params.where("done").select(*columns))


def _literals(mixture: Mixture) -> tuple[list[Column], list[Column], list[Column]]:
    return (
        [F.lit(float(w)) for w in mixture.weights],
        [F.lit(float(m)) for m in mixture.means],
        [F.lit(float(v)) for v in mixture.variances],
    )


def _score(df: DataFrame, value_col: str, k: int, parts, out: str, cluster: str | None) -> DataFrame:
    x = F.col(quoted(value_col)).cast("double")
    scored = _with_responsibilities(df, x, *parts)
    shares = [F.col(f"_r{j}") for j in range(1, k + 1)]
    packed = F.struct(*[r.alias(f"{value_col}_{j}") for j, r in enumerate(shares, 1)])
    scored = scored.withColumn(out, packed)
    if cluster:
        best = F.greatest(*shares) if k > 1 else shares[0]
        label = F.coalesce(*[F.when(r == best, F.lit(j)) for j, r in enumerate(shares)])
        scored = scored.withColumn(cluster, label)
    return scored.drop("_lse", *[f"_r{j}" for j in range(1, k + 1)])


def mixture_memberships(
    df: DataFrame,
    value_col: str,
    components: int = 3,
    name: str | None = None,
    cluster: bool = False,
    mixture: Mixture | None = None,
) -> DataFrame:
    """Fit a mixture to a column and add the struct of posterior shares.

    The struct is ``<col>_guassian_splines`` with fields ``<col>_1..k``; with
    ``cluster`` also the 0-based best component as ``<col>_cluster``. Scoring
    uses the parameters as literals and stays in the JVM.
    """
    mixture = mixture or fit_mixture(df, value_col, components)
    parts = _literals(mixture)
    return _score(
        df, value_col, components, parts, name or f"{value_col}_guassian_splines", f"{value_col}_cluster" if cluster else None
    )


def mixture_memberships_by_group(
    df: DataFrame,
    value_col: str,
    components: int,
    group_cols: Sequence[str],
    name: str | None = None,
    params: DataFrame | None = None,
) -> DataFrame:
    """The same with one mixture per group; parameters joined on the group."""
    keys = list(group_cols)
    params = params if params is not None else fit_mixtures(df, value_col, components, keys)
    renamed = params.select(
        *keys, F.col("weights").alias("_w"), F.col("means").alias("_m"), F.col("variances").alias("_v")
    )
    parts = [[F.col(c)[j] for j in range(components)] for c in ("_w", "_m", "_v")]
    joined = df.join(renamed, keys)
    return _score(joined, value_col, components, parts, name or f"{value_col}_guassian_splines", None).drop("_w", "_m", "_v")
