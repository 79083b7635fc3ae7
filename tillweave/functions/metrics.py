"""Forecast error aggregates, for use inside ``groupBy().agg(...)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillweave.functions.maths import safe_divide


def wape(actual: Column, predicted: Column) -> Column:
    """Sum of absolute errors over the sum of actuals."""
    return safe_divide(F.sum(F.abs(actual - predicted)), F.sum(actual))


def mse(actual: Column, predicted: Column) -> Column:
    return F.avg((actual - predicted) * (actual - predicted))


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(mse(actual, predicted))


def mae(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(actual - predicted))


def mape(actual: Column, predicted: Column) -> Column:
    """Mean absolute percentage error, in percent, over rows with actual <> 0."""
    return F.avg(F.when(actual != 0, F.abs(actual - predicted) / actual)) * F.lit(100.0)


def bias(actual: Column, predicted: Column) -> Column:
    """Sum of predictions over the sum of actuals; 1 means unbiased."""
    return safe_divide(F.sum(predicted), F.sum(actual))
