"""Exact quantiles of whole columns without gathering them."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.operators.relational import quoted

# Error bound of the sketch that brackets a rank, as 1 / accuracy.
SKETCH_ACCURACY = 10_000


@dataclass
class _Search:
    """One wanted rank of one column: the open interval it lies in, and what lies at or below its low end."""

    column: str
    share: float
    rank: int = 0
    low: Any = None
    high: Any = None
    below: int = 0
    inside: int = 0
    found: Any = None
    done: bool = False

    def member(self) -> Column:
        x = F.col(quoted(self.column))
        held = x.isNotNull()
        if self.low is not None:
            held = held & (x > F.lit(self.low))
        if self.high is not None:
            held = held & (x < F.lit(self.high))
        return held

    def ends(self, accuracy: int) -> Column:
        share = (self.rank - self.below) / self.inside if self.rank else self.share
        slack = 2.0 / accuracy
        marks = [max(0.0, share - slack), min(1.0, share + slack)]
        return F.percentile_approx(F.when(self.member(), F.col(quoted(self.column))), marks, accuracy)

    def narrow(self, low, high, counts: Sequence[int]) -> None:
        """Counts: rows below and up to the low mark, below and up to the high mark."""
        under_low, to_low, under_high, to_high = counts
        if under_low < self.rank <= to_low:
            self.found, self.done = low, True
        elif under_high < self.rank <= to_high:
            self.found, self.done = high, True
        elif self.rank <= under_low:
            self.high, self.inside = low, under_low - self.below
        elif self.rank > to_high:
            self.low, self.inside, self.below = high, self.inside - (to_high - self.below), to_high
        else:
            self.low, self.high, self.below, self.inside = low, high, to_low, under_high - to_low


def exact_quantiles_of(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], accuracy: int = SKETCH_ACCURACY
) -> dict[str, list]:
    """Per column the smallest values whose cumulative share reaches each probability.

    ``percentile_disc`` holds every distinct value of a column in one task. Here
    mergeable sketches bracket the wanted ranks, counts at the bracket's ends
    either hit a rank or show on which side of them it lies, and this repeats
    between the ends. Every round takes two jobs for all columns and ranks
    together, removes two values at least and shrinks a bracket by the
    sketch's accuracy, so 10^11 rows take three. Only counts and bracket ends
    reach the driver. A column without values gives nulls.
    """
    searches = [_Search(c, p) for c, shares in wanted.items() for p in shares]
    names = list(wanted)
    if not names:
        return {}
    first = df.agg(
        F.array(*[F.count(quoted(c)) for c in names]).alias("sizes"), *[s.ends(accuracy).alias(f"e{i}") for i, s in enumerate(searches)]
    ).first()
    sizes = dict(zip(names, first["sizes"]))
    for s in searches:
        s.inside = sizes[s.column]
        s.rank = max(1, math.ceil(s.share * s.inside - 1e-9))
        s.done = s.inside == 0
    ends = {i: first[f"e{i}"] for i in range(len(searches))}
    while True:
        still = [i for i, s in enumerate(searches) if not s.done]
        if not still:
            break
        counts = df.agg(*[_counts(searches[i].column, *ends[i]).alias(f"n{i}") for i in still]).first()
        for i in still:
            searches[i].narrow(*ends[i], counts[f"n{i}"])
        still = [i for i in still if not searches[i].done]
        if still:
            row = df.agg(*[searches[i].ends(accuracy).alias(f"e{i}") for i in still]).first()
            ends = {i: row[f"e{i}"] for i in still}
    out: dict[str, list] = {c: [] for c in names}
    for s in searches:
        out[s.column].append(s.found)
    return out


def _counts(column: str, low, high) -> Column:
    x = F.col(quoted(column))
    return F.array(*[F.count_if(c) for c in (x < F.lit(low), x <= F.lit(low), x < F.lit(high), x <= F.lit(high))])


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float], accuracy: int = SKETCH_ACCURACY) -> list:
    """``exact_quantiles_of`` for one column."""
    return exact_quantiles_of(df, {column: probabilities}, accuracy)[column]


def quantile_tails(df: DataFrame, column: str, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Rows at or below the lower, or at or above the upper quantile."""
    low, high = exact_quantiles(df, column, [lower, upper])
    x = F.col(quoted(column))
    return df.where((x <= F.lit(low)) | (x >= F.lit(high)))
