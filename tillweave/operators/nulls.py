"""Null handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in any (named) column."""
    return df.dropna(how="any", subset=list(columns) if columns else None)


def fill_zero(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric nulls to 0; structs and other types stay as they are."""
    return df.na.fill(0, subset=list(columns) if columns else None)


def fill_backward(value: Column, id_col: str | Sequence[str], date_col: str) -> Column:
    """The next non-null value of the same series.

    As the last one so far in falling order: each row is visited once.
    """
    keys = [id_col] if isinstance(id_col, str) else list(id_col)
    falling = (
        Window.partitionBy(*keys)
        .orderBy(F.col(date_col).desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return F.last(value, ignorenulls=True).over(falling)
