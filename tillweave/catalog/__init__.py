"""All registered queries, by area."""

from tillweave.catalog import (  # noqa: F401
    aggregates,
    backtests,
    columns,
    features,
    joins,
    pipelines,
    reshaping,
    series,
    storage,
    windowing,
)
from tillweave.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
