"""Wide-to-long, long-to-wide, explode and stack."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillweave.catalog.registry import query
from tillweave.operators import reshape, summaries
from tillweave.plans import events as event_plans
from tillweave.sources import sample_tables as tables
from tillweave.sources.sample_tables import EVENT_NAMES, EVENT_TYPES, table


@query(
    "melt_wide_sales",
    """SELECT id, 'd_' || CAST(date - lo + 1 AS VARCHAR) AS day, CAST(sales AS SMALLINT) AS sales FROM sales_long, bounds""",
)
def melt_wide_sales(spark, data_dir):
    return reshape.melt_wide(tables.sales_wide(spark, data_dir))


@query(
    "unpivot_columns",
    """SELECT l_orderkey, l_linenumber, variable, value FROM (
         SELECT l_orderkey, l_linenumber, 'l_quantity' AS variable, l_quantity AS value FROM lineitem
         UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem
         UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem)""",
)
def unpivot_columns(spark, data_dir):
    return reshape.unpivot_columns(
        table(spark, data_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"]
    )


@query(
    "pivot_fill",
    """SELECT l_partkey, coalesce(max(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 0) AS "A",
              coalesce(max(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 0) AS "N",
              coalesce(max(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0) AS "R" FROM lineitem GROUP BY l_partkey""",
)
def pivot_fill(spark, data_dir):
    return reshape.pivot_fill(
        table(spark, data_dir, "lineitem"), index="l_partkey", on="l_returnflag", values="l_quantity", value_list=["A", "N", "R"]
    )


@query(
    "pivot_multi_value",
    """SELECT l_suppkey, """
    + ", ".join(
        f"""coalesce(max(CASE WHEN l_returnflag = '{f}' THEN {c} END), 0) AS "{f}_{c}" """
        for f in "ANR"
        for c in ("l_quantity", "l_tax")
    )
    + "FROM lineitem GROUP BY l_suppkey",
)
def pivot_multi_value(spark, data_dir):
    return reshape.pivot_fill(
        table(spark, data_dir, "lineitem"), "l_suppkey", "l_returnflag", ["l_quantity", "l_tax"], ["A", "N", "R"]
    )


@query(
    "pivot_count",
    """SELECT o_custkey, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS "F",
              CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS "O",
              CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS "P" FROM orders GROUP BY o_custkey""",
)
def pivot_count(spark, data_dir):
    return reshape.pivot_count(table(spark, data_dir, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])


@query(
    "explode_list",
    """SELECT p_partkey, unnest(CASE WHEN contains(p_name, ' ') THEN string_split(p_name, ' ') ELSE [NULL] END) AS word FROM part""",
)
def explode_list(spark, data_dir):
    """Words of part names; a name of one word has an empty list and gives one null row."""
    words = F.split("p_name", " ")
    listed = table(spark, data_dir, "part").select(
        "p_partkey", F.when(F.size(words) > 1, words).otherwise(F.array().cast("array<string>")).alias("words")
    )
    return reshape.explode_list(listed, "words", "word")


@query(
    "union_all",
    """SELECT c_custkey AS party, c_nationkey AS nation, c_acctbal AS balance, 'customer' AS kind FROM customer
       UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal, 'supplier' FROM supplier""",
)
def union_all(spark, data_dir):
    buyers = table(spark, data_dir, "customer").select(
        F.col("c_custkey").alias("party"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("kind")
    )
    sellers = table(spark, data_dir, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("party"), F.lit("supplier").alias("kind")
    )
    return reshape.union_all(buyers, sellers)


@query(
    "union_align",
    """SELECT c_custkey AS party, c_mktsegment, NULL AS s_acctbal FROM customer
       UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier""",
)
def union_align(spark, data_dir):
    return reshape.union_align(
        table(spark, data_dir, "customer").select(F.col("c_custkey").alias("party"), "c_mktsegment"),
        table(spark, data_dir, "supplier").select(F.col("s_suppkey").alias("party"), "s_acctbal"),
    )


def _flags(names, column):
    quoted = [(n, n.replace("'", "''")) for n in names]
    return ", ".join(
        f"""CAST(coalesce(max(CASE WHEN {column} = '{q}' THEN 1 END), 0) AS INTEGER) AS "{n}" """ for n, q in quoted
    )


@query(
    "pivot_two_level",
    f"SELECT date, {_flags(EVENT_TYPES, 'event_type')}, {_flags(EVENT_NAMES, 'event_name')} FROM event_days GROUP BY date",
)
def pivot_two_level(spark, data_dir):
    """One 0/1 column per event type and per event name, for days with an event."""
    calendar = tables.calendar(spark, data_dir)
    return event_plans.event_matrix(summaries.event_days(calendar), EVENT_NAMES, EVENT_TYPES)
