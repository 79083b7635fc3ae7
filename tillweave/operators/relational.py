"""Projection, join and lookup operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted join kinds and Spark's names for them.
JOIN_KINDS = {
    "inner": "inner",
    "left": "left",
    "right": "right",
    "full": "full",
    "semi": "left_semi",
    "anti": "left_anti",
    "cross": "cross",
}


def join_tables(
    left: DataFrame, right: DataFrame, on: Sequence[str] | None = None, how: str = "inner"
) -> DataFrame:
    """Equality join on shared column names.

    No hint is given: Spark broadcasts a side it measures as small, statically
    or at run time, and shuffles (splitting skewed keys) otherwise.
    """
    if how not in JOIN_KINDS:
        raise ValueError(f"unknown join kind {how!r}, expected one of {sorted(JOIN_KINDS)}")
    if how == "cross":
        if on is not None:
            raise ValueError("a cross join takes no keys")
        return left.crossJoin(right)
    if on is None:
        raise ValueError(f"a {how} join needs keys in 'on'")
    return left.join(right, list(on), JOIN_KINDS[how])


def select_columns(df: DataFrame, columns: Sequence[str | Column] | Column) -> DataFrame:
    """Keep columns given as a list or as one expression."""
    if isinstance(columns, Column):
        return df.select(columns)
    return df.select(*columns)


def select_except(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """All columns but the named ones."""
    dropped = set(names)
    return df.select(*[F.col(quoted(c)) for c in df.columns if c not in dropped])


def quoted(name: str) -> str:
    """Column name in backticks, for names with spaces, dots or quotes."""
    return "`" + name.replace("`", "``") + "`"


def apply_transform(df: DataFrame, step: Callable[..., DataFrame], *args, **kwargs) -> DataFrame:
    """Plug a user function into a chain of transforms."""
    return df.transform(step, *args, **kwargs)


def pack_struct(df: DataFrame, columns: Sequence[str], name: str, drop: bool = False) -> DataFrame:
    """Pack columns into one struct column."""
    packed = df.withColumn(name, F.struct(*[F.col(quoted(c)) for c in columns]))
    return packed.drop(*columns) if drop else packed


def unnest_struct(df: DataFrame, *names: str) -> DataFrame:
    """Replace struct columns by their fields, at the end of the row."""
    rest = [F.col(quoted(c)) for c in df.columns if c not in names]
    return df.select(*rest, *[F.col(f"{quoted(n)}.*") for n in names])


def struct_fields(df: DataFrame, *names: str) -> list[str]:
    """Field names of struct columns, from the schema alone."""
    return [field for n in names for field in df.schema[n].dataType.fieldNames()]


def lookup_strict(
    source: str | Column, mapping: Mapping, default=None, strict: bool = True
) -> Column:
    """Map codes to labels; a miss is an error, or the default if not strict."""
    key = F.col(source) if isinstance(source, str) else source
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.try_element_at(table, key)
    if not strict:
        return F.coalesce(found, F.lit(default))
    miss = F.raise_error(F.concat(F.lit("no entry for "), key.cast("string")))
    return F.when(key.isNull(), F.lit(None)).when(found.isNotNull(), found).otherwise(miss)


def hash_column(df: DataFrame, column: str, new_name: str, seed: int = 4) -> DataFrame:
    """60-bit surrogate id; equal values get equal ids in every run and engine. Null stays null."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")).cast("binary")), 1, 15)
    return df.withColumn(new_name, F.conv(digits, 16, 10).cast("bigint"))


def attach_group_stat(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Add statistics of each row's group.

    Aggregates first and joins the small result back, so that a group of any
    size is reduced on the map side instead of being held by one task.
    """
    grouped = df.groupBy(*keys).agg(*[stat.alias(name) for name, stat in stats.items()])
    return df.join(grouped, list(keys), "left")


def sample_rows(df: DataFrame, n: int, seed: int = 42, by: Sequence[str] | None = None) -> DataFrame:
    """Exactly n rows (or all), the same ones for the same seed and data.

    Orders by a hash of the row, so the choice does not depend on how the data
    is partitioned; Spark keeps n rows per task and merges them. Other engines
    draw the same rows.
    """
    columns = list(by) if by else df.columns
    text = F.concat_ws(",", F.lit(str(seed)), *[F.col(quoted(c)).cast("string") for c in columns])
    order = F.md5(text.cast("binary"))
    return df.orderBy(order, *[F.col(quoted(c)) for c in columns]).limit(n)
