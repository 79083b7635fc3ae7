"""Distinct counts from mergeable sketches.

A sketch of each day is stored once; any period is the union of its days, without another look at the rows. A sketch
has at most 2^lg_k registers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.operators.relational import quoted

# Fixed value: registers as a power of two; the standard error is 1.04 / sqrt(2^lg_k), 0.8 % here.
LG_K = 14


def distinct_sketches(df: DataFrame, by: Sequence[str], value: str, lg_k: int = LG_K) -> DataFrame:
    """(by, sketch): one sketch per group; nulls are not counted."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(F.col(quoted(value)), F.lit(lg_k)).alias("sketch"))


def rolled_up(sketches: DataFrame, *by: Column) -> DataFrame:
    """(by, estimate): distinct counts of longer periods, from the union of their sketches."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def error_bound(count: Column, lg_k: int = LG_K) -> Column:
    """Three standard errors of a count, and one for rounding."""
    return F.lit(3 * 1.04 / 2 ** (lg_k / 2)) * count + 1
