"""Window columns over series (id, date)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillweave.functions.maths import safe_divide


def _series(id_col: str | Sequence[str], date_col: str):
    keys = [id_col] if isinstance(id_col, str) else list(id_col)
    return Window.partitionBy(*keys).orderBy(date_col)


def lag_delta(value: Column, id_col: str | Sequence[str], date_col: str) -> Column:
    """Value minus the previous one; null on the first row."""
    return value - F.lag(value, 1).over(_series(id_col, date_col))


def running_sum(value: Column, id_col: str | Sequence[str], date_col: str) -> Column:
    frame = _series(id_col, date_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(value).over(frame)


def running_product(value: Column, id_col: str | Sequence[str], date_col: str) -> Column:
    frame = _series(id_col, date_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.product(value).over(frame)


def position_in_group(id_col: str | Sequence[str], date_col: str) -> Column:
    """0-based position in date order."""
    return F.row_number().over(_series(id_col, date_col)) - 1


def day_trend(df: DataFrame, date_col: str = "date", name: str = "trend") -> DataFrame:
    """0-based row index of a gapless calendar, as days since its first date.

    A subtraction instead of a global sort.
    """
    first = df.agg(F.min(date_col)).scalar()
    return df.withColumn(name, F.datediff(F.col(date_col), first).cast("long"))


def rolling_std_rows(value: Column, id_col: str | Sequence[str], date_col: str, rows: int = 7) -> Column:
    """Sample std over the last ``rows`` rows; null until that many are there."""
    frame = _series(id_col, date_col).rowsBetween(-(rows - 1), Window.currentRow)
    return F.when(F.count(value).over(frame) == rows, F.stddev_samp(value).over(frame))


def rolling_std_days(value: str, id_cols: str | Sequence[str], date_col: str, days: int = 30) -> Column:
    """Sample std over the dates in (t - days, t].

    A range frame over the day number, so that several rows of one day and
    missing days are right.
    """
    keys = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    frame = Window.partitionBy(*keys).orderBy(F.unix_date(date_col)).rangeBetween(-(days - 1), 0)
    return F.stddev_samp(value).over(frame)


def linear_ramp(start: float, end: float, id_cols: str | Sequence[str], date_col: str) -> Column:
    """Evenly spaced values from start to end along each series."""
    keys = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    position = position_in_group(keys, date_col)
    steps = F.count(F.lit(1)).over(Window.partitionBy(*keys)) - 1
    share = F.coalesce(safe_divide(position, steps), F.lit(0.0))
    return F.lit(start) + share * F.lit(end - start)
