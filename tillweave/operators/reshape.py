"""Wide-to-long, long-to-wide and stacking operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.operators.relational import quoted


def melt_wide(
    df: DataFrame,
    id_col: str = "id",
    drop_columns: Sequence[str] = ("item_id", "dept_id", "cat_id", "store_id", "state_id"),
    name_col: str = "day",
    value_col: str = "sales",
    value_type: str = "smallint",
) -> DataFrame:
    """Turn a file with one column per day into rows (id, day, value).

    One array per row is exploded. ``unpivot`` would build one projection per
    column, which is slow for thousands of columns. The cast raises on
    overflow.
    """
    dropped = {id_col, *drop_columns}
    names = [c for c in df.columns if c not in dropped]
    values = ", ".join(quoted(c) for c in names)
    labels = "array(" + ", ".join("'" + c.replace("'", "\\'") + "'" for c in names) + ")"
    return df.selectExpr(
        quoted(id_col), f"posexplode(array({values})) AS (_pos, _value)"
    ).selectExpr(
        quoted(id_col),
        f"element_at({labels}, _pos + 1) AS {quoted(name_col)}",
        f"CAST(_value AS {value_type}) AS {quoted(value_col)}",
    )


def unpivot_columns(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], name_col: str = "variable", value_col: str = "value"
) -> DataFrame:
    """Melt a few named columns."""
    return df.unpivot(
        [F.col(quoted(c)) for c in ids], [F.col(quoted(c)) for c in columns], name_col, value_col
    )


def pivot_fill(
    df: DataFrame,
    index: str | Sequence[str] | None = None,
    on: str | None = None,
    values: str | Sequence[str] | None = None,
    value_list: Sequence | None = None,
    how: str = "max",
    fill=0,
) -> DataFrame:
    """Pivot with nulls filled. ``value_list`` names the columns, so no job has to find them.

    Several value columns give columns ``<key>_<value>``.
    """
    if index is None or on is None or values is None or value_list is None:
        raise ValueError("index, on, values and value_list must all be given")
    keys = [index] if isinstance(index, str) else list(index)
    cells = [values] if isinstance(values, str) else list(values)
    value_list = list(value_list)
    aggregate = getattr(F, how)
    pivoted = df.groupBy(*keys).pivot(on, value_list)
    if len(cells) == 1:
        wide = pivoted.agg(aggregate(quoted(cells[0])))
    else:
        wide = pivoted.agg(*[aggregate(quoted(c)).alias(c) for c in cells])
    made = [c for c in wide.columns if c not in keys]
    if fill is None or not made:
        return wide
    return wide.select(*keys, *[F.coalesce(F.col(quoted(c)), F.lit(fill)).alias(c) for c in made])


def pivot_count(
    df: DataFrame, index: str | Sequence[str], on: str, value_list: Sequence
) -> DataFrame:
    """Pivot that counts rows; 0 where there are none."""
    keys = [index] if isinstance(index, str) else list(index)
    value_list = list(value_list)
    wide = df.groupBy(*keys).pivot(on, value_list).agg(F.count(F.lit(1)))
    return wide.select(
        *keys, *[F.coalesce(F.col(quoted(str(v))), F.lit(0)).alias(str(v)) for v in value_list]
    )


def explode_list(df: DataFrame, column: str, name: str | None = None, keep_empty: bool = True) -> DataFrame:
    """List elements to rows; an empty or null list keeps one null row."""
    step = F.explode_outer if keep_empty else F.explode
    rest = [F.col(quoted(c)) for c in df.columns if c != column]
    return df.select(*rest, step(F.col(quoted(column))).alias(name or column))


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Stack frames with the same columns, matched by name."""
    for other in others:
        first = first.unionByName(other)
    return first


def union_align(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Stack frames with different columns; missing ones become null."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def list_of(column: str, distinct: bool = False) -> Column:
    """Sorted list of a group's values; for groups of bounded size."""
    return F.sort_array(F.collect_set(column) if distinct else F.collect_list(column))
