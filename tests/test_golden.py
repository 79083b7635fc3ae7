"""Worked examples with known results."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tillweave.functions.dates import date_span, days_around
from tillweave.functions.maths import binomial_pmf, log_factorial
from tillweave.functions.text import take_parts
from tillweave.operators.panel import densify_daily, flag_out_of_stock, trim_before_first_sale, zero_sales_runs
from tillweave.operators.reshape import melt_wide
from tillweave.plans.backtest import Splits, rolling_splits
from tillweave.plans.events import post_event_days
from tillweave.schemas import CALENDAR_SCHEMA

DAY = date(2015, 1, 1)


def panel(spark, sales, key="a"):
    rows = [(key, DAY + timedelta(days=i), s) for i, s in enumerate(sales)]
    return spark.createDataFrame(rows, "id string, date date, sales int")


def column(df, name, order="date"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def test_out_of_stock_example(spark):
    df = panel(spark, [5, 0, 0, 0, 3, 0, 0, 4])
    detail = flag_out_of_stock(df, 0.25, keep_detail=True)
    assert column(detail, "zero_sales_ind") == [0, 1, 1, 1, 0, 1, 1, 0]
    assert column(detail, "zero_sales_period") == [None, 1, 1, 1, 0, 2, 2, 0]
    assert detail.agg(F.max("prob_zero_sales")).first()[0] == 0.625
    assert column(flag_out_of_stock(df, 0.0001), "OOS") == [0] * 8
    assert column(flag_out_of_stock(df, 0.25), "OOS") == [0, 1, 1, 1, 0, 0, 0, 0]


def test_leading_zeros(spark):
    df = panel(spark, [0, 0, 0, 5, 0, 0, 3])
    assert column(zero_sales_runs(df), "zero_sales_period") == [None, 0, 0, 0, 1, 1, 0]
    flagged = flag_out_of_stock(df, 0.9, keep_detail=True)
    assert column(flagged, "OOS") == [0, 1, 1, 0, 1, 1, 0]
    assert column(trim_before_first_sale(df), "sales") == [5, 0, 0, 3]


def test_series_of_zeros_is_never_flagged(spark):
    df = panel(spark, [0] * 50)
    assert column(flag_out_of_stock(df, 0.0001), "OOS") == [0] * 50
    assert trim_before_first_sale(df).count() == 0


def test_chosen_ids_only(spark):
    df = panel(spark, [1, 0], "a").unionByName(panel(spark, [1, 0], "b"))
    assert {r["id"] for r in flag_out_of_stock(df, ids=["b"]).collect()} == {"b"}


def test_densify(spark):
    df = panel(spark, [4]).withColumn("date", F.date_add("date", 2)).unionByName(
        panel(spark, [7]).withColumn("date", F.date_add("date", 5))
    )
    full = densify_daily(df, F.lit(DAY), F.lit(DAY + timedelta(days=6)))
    assert column(full, "sales") == [0, 0, 4, 0, 0, 7, 0]
    assert column(full, "date") == [DAY + timedelta(days=i) for i in range(7)]


@pytest.mark.parametrize(
    ("k", "n", "p", "expected"),
    [(3, 10, 0.5, 0.1171875), (10, 10, 0.2, 1.024e-7), (0, 5, 0.0, 1.0), (5, 5, 1.0, 1.0), (2, 5, 1.0, 0.0), (30, 60, 0.5, 0.10257817300856)],
)
def test_binomial_pmf(spark, k, n, p, expected):
    got = spark.range(1).select(binomial_pmf(F.lit(k), F.lit(n), F.lit(p))).first()[0]
    assert got == pytest.approx(expected, rel=1e-9)


def test_log_factorial(spark):
    import math

    rows = spark.range(0, 200).select("id", log_factorial(F.col("id"))).collect()
    for n, got in rows:
        assert got == pytest.approx(math.lgamma(n + 1), rel=1e-11, abs=1e-11)


def test_likelihood_table(spark):
    df = spark.createDataFrame([(2, 0.1), (5, 0.2), (6, 0.3)], "period int, p double")
    got = df.orderBy("period").select(F.factorial("period"), F.pow("p", "period")).collect()
    assert [g[0] for g in got] == [2, 120, 720]
    assert [g[1] for g in got] == pytest.approx([0.01, 0.00032, 0.000729])


def test_split_count(spark):
    splits = Splits(F.lit(date(2013, 1, 29)), F.lit(date(2016, 1, 29)))
    days = spark.sql("SELECT explode(sequence(date'2010-01-01', date'2016-05-22')) AS date")
    rows = rolling_splits(days, splits)
    assert rows.agg(F.countDistinct("set_index")).first()[0] == 36
    assert rows.agg(F.max("set_first_date")).first()[0] == date(2015, 12, 15)
    sizes = {(r["set_index"], r["set_type"]): r["count"] for r in rows.groupBy("set_index", "set_type").count().collect()}
    assert {v for (_, t), v in sizes.items() if t == "train"} == {1095}
    assert {v for (_, t), v in sizes.items() if t == "pred"} == {30}


def test_id_parts(spark):
    df = spark.createDataFrame([("FOODS_3_019_CA_3_evaluation",), ("BAD_ID",)], "id string")
    got = df.select(take_parts(F.col("id"), [0, 1]), take_parts(F.col("id"), [3, 4])).collect()
    assert tuple(got[0]) == ("FOODS_3", "CA_3")
    assert tuple(got[1]) == ("BAD_ID", None)


def test_date_lists(spark):
    row = spark.range(1).select(
        days_around(F.lit(DAY), 4, 4).alias("near"),
        date_span(F.lit(DAY), F.lit(DAY - timedelta(days=1))).alias("none"),
    ).first()
    assert row["near"] == [DAY + timedelta(days=i) for i in range(-4, 5)]
    assert row["none"] == []


def test_post_event_name(spark):
    row = (date(2015, 2, 1), "d_1", 1, "Sunday", 2, "SuperBowl", "Sporting", None, None, 0, 0, 0)
    days = post_event_days(spark.createDataFrame([row], CALENDAR_SCHEMA))
    named = {r["feature"]: r["range"] for r in days.collect()}
    assert named["EVENT_SPORTING_SUPERBOWL_3"] == date(2015, 2, 4)
    assert len(named) == 7


def test_melt_reads_names_and_raises_on_overflow(spark):
    wide = spark.createDataFrame([("a", "x", 1, 40_000)], "id string, item_id string, d_1 int, d_2 int")
    rows = melt_wide(wide, "id", ["item_id"], value_type="int").collect()
    assert [tuple(r) for r in rows] == [("a", "d_1", 1), ("a", "d_2", 40_000)]
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        melt_wide(wide, "id", ["item_id"]).collect()
