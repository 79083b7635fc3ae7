"""Grouped and whole-table summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.operators.quantiles import exact_quantiles_of
from tillweave.operators.relational import quoted
from tillweave.session import scratch_folder


# Slices of a group's values when quantiles are looked up.
QUANTILE_SLICES = 64


def event_days(calendar: DataFrame) -> DataFrame:
    """Both event column pairs stacked to (date, event_name, event_type)."""
    pairs = F.array(
        *[
            F.struct(F.col(f"event_name_{i}").alias("event_name"), F.col(f"event_type_{i}").alias("event_type"))
            for i in (1, 2)
        ]
    )
    return (
        calendar.select("date", F.explode(pairs).alias("event"))
        .select("date", "event.event_name", "event.event_type")
        .where(F.col("event_name").isNotNull() & F.col("event_type").isNotNull())
    )


def sum_all(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum every numeric column that is not a key; names stay."""
    numeric = [
        f.name for f in df.schema.fields if f.name not in keys and isinstance(f.dataType, T.NumericType)
    ]
    return df.groupBy(*keys).agg(*[F.sum(quoted(c)).alias(c) for c in numeric])


def group_by_all_but(df: DataFrame, measures: Sequence[str], *aggregates: Column) -> DataFrame:
    """Group by all columns except the measures; structs may be keys."""
    keys = [F.col(quoted(c)) for c in df.columns if c not in set(measures)]
    return df.groupBy(*keys).agg(*aggregates)


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float]
) -> DataFrame:
    """Discrete quantiles per group: the smallest value whose share of rows reaches q.

    Rows are first counted per (group, value). A sketch of each group cuts its
    values into ``QUANTILE_SLICES`` slices; counts per slice tell which slices
    hold the wanted ranks, and only those are sorted, each on its own. So a
    group with many distinct values meets no single task. The counts are
    written once, as all three steps read them.
    """
    keys, x = list(keys), F.col(quoted(value))
    counted = df.where(x.isNotNull()).groupBy(*keys, x.alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    folder = scratch_folder(df.sparkSession, "quantiles")
    counted.write.mode("overwrite").parquet(folder)
    counted = df.sparkSession.read.schema(counted.schema).parquet(folder)
    marks = [i / QUANTILE_SLICES for i in range(1, QUANTILE_SLICES)]
    cuts = counted.groupBy(*keys).agg(F.percentile_approx("_x", marks, 1000).alias("_cuts"), F.sum("_n").alias("_total"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
    sliced = counted.alias("c").join(cuts.alias("g"), same).select(
        *[F.col(f"c.{k}").alias(k) for k in keys], "_x", "_n", "_total",
        F.size(F.filter("_cuts", lambda c: c < F.col("_x"))).alias("_slice"),
    )
    so_far = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_slice")) - F.col("_rows")
    slices = sliced.groupBy(*keys, "_slice", "_total").agg(F.sum("_n").alias("_rows")).withColumn("_before", so_far)
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.ceil(F.col("_total") * q - 1e-9).alias("rank")) for name, q in quantiles.items()])
    least = F.transform(ranks, lambda r: F.struct(r["name"].alias("name"), F.greatest(r["rank"], F.lit(1)).alias("rank")))
    inside = F.filter(least, lambda r: (r["rank"] > F.col("_before")) & (r["rank"] <= F.col("_before") + F.col("_rows")))
    hit = slices.withColumn("_wanted", inside).where(F.size("_wanted") > 0).drop("_total", "_rows")
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"h.{k}")) for k in [*keys, "_slice"]]
    chosen = sliced.alias("s").join(hit.alias("h"), same).select(
        *[F.col(f"s.{k}").alias(k) for k in keys], F.col("s._slice").alias("_slice"), "_x", "_n", "_before", "_wanted"
    )
    ordered = Window.partitionBy(*keys, "_slice").orderBy("_x")
    reached = chosen.withColumn("_reached", F.col("_before") + F.sum("_n").over(ordered))

    def pick(name: str) -> Column:
        due = F.exists("_wanted", lambda r: (r["name"] == name) & (F.col("_reached") >= r["rank"]))
        return F.min(F.when(due, F.col("_x"))).alias(name)

    return reached.groupBy(*keys).agg(*[pick(name) for name in quantiles])


def describe(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Count, mean, std, min, quartiles and max, one row per numeric column.

    Moments come from one pass; quartiles are exact, taken for all columns in
    shared passes and without gathering one.
    """
    parts = []
    quartiles = exact_quantiles_of(df, {c: [0.25, 0.5, 0.75] for c in columns})
    for c in columns:
        x = F.col(quoted(c))
        q25, q50, q75 = quartiles[c]
        parts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(x).alias("count"),
                F.round(F.avg(x), digits).alias("mean"),
                F.round(F.stddev_samp(x), digits).alias("std"),
                F.min(x).alias("min"),
                F.lit(q25).alias("q25"),
                F.lit(q50).alias("q50"),
                F.lit(q75).alias("q75"),
                F.max(x).alias("max"),
            )
        )
    return df.agg(F.array(*parts).alias("stats")).select(F.inline("stats"))
