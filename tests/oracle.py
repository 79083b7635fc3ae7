"""Compare registered queries with their SQL twins in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(data_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{data_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if value is None:
        return "null"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """Return None if equal, else a short description of the difference."""
    spark_cols, spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    duck_cols, duck_rows = rows_of(names, cursor.fetchall())
    if spark_cols != duck_cols:
        return f"columns {spark_cols} != {duck_cols}"
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} != {len(duck_rows)}: {spark_rows[:2]} / {duck_rows[:2]}"
    for a, b in zip(spark_rows, duck_rows):
        if a != b:
            wrong = sum(x != y for x, y in zip(spark_rows, duck_rows))
            return f"{wrong} of {len(spark_rows)} rows differ, first {a} != {b}"
    return None
