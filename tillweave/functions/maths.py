"""Numeric expressions."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(top: Column, bottom: Column) -> Column:
    """Quotient as double; null instead of an error when the divisor is 0."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def safe_log(value: Column) -> Column:
    """Natural log; null for values at or below 0."""
    return F.when(value > 0, F.log(value))


def safe_log10(value: Column) -> Column:
    """Base-10 log; null for values at or below 0."""
    return F.when(value > 0, F.log10(value))


def row_sum(columns: Iterable[Column]) -> Column:
    """Sum over columns of one row, nulls as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in columns])


def harmonic_angle(position: Column, period: float, harmonic: int) -> Column:
    """2*pi*k*t/period in double arithmetic."""
    return F.lit(2.0 * math.pi * harmonic) * position.cast("double") / F.lit(float(period))


def logistic(value: Column, midpoint: Column, steepness: float) -> Column:
    """1 / (1 + exp(-k (x - x0)))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(value - midpoint) * F.lit(steepness)))


def log_factorial(n: Column) -> Column:
    """ln(n!): exact through 20, Stirling's series (error below 1e-12) beyond."""
    x = n.cast("double")
    series = (
        x * F.log(x)
        - x
        + F.lit(0.5) * F.log(F.lit(2.0 * math.pi) * x)
        + F.lit(1.0) / (F.lit(12.0) * x)
        - F.lit(1.0) / (F.lit(360.0) * F.pow(x, F.lit(3.0)))
        + F.lit(1.0) / (F.lit(1260.0) * F.pow(x, F.lit(5.0)))
    )
    small = F.log(F.factorial(n.cast("int")).cast("double"))
    return F.when((n >= 0) & (n <= 20), small).when(n > 20, series)


def factorial(n: Column) -> Column:
    """n! as a double: exact through 20, to a relative error of 1e-10 beyond, infinite above 170."""
    return F.when(n <= 20, F.factorial(n.cast("int")).cast("double")).otherwise(F.exp(log_factorial(n)))


def binomial_pmf(successes: Column, trials: Column, p: Column) -> Column:
    """C(n, k) p^k (1-p)^(n-k), computed in logs so that large n stay finite."""
    k, n = successes.cast("double"), trials.cast("double")
    log_choose = log_factorial(trials) - log_factorial(successes) - log_factorial(trials - successes)
    # 0 * ln 0 counts as 0: a sure (or impossible) event with no trial against it.
    hits = F.when(successes == 0, F.lit(0.0)).otherwise(k * F.log(p))
    misses = F.when(successes == trials, F.lit(0.0)).otherwise((n - k) * F.log(F.lit(1.0) - p))
    impossible = ((p <= 0) & (successes > 0)) | ((p >= 1) & (successes < trials))
    return (
        F.when((successes < 0) | (successes > trials), F.lit(0.0))
        .when(impossible, F.lit(0.0))
        .otherwise(F.exp(log_choose + hits + misses))
    )
