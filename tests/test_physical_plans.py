"""Plan shapes that keep the jobs scalable."""

import re

import pytest
from pyspark.sql import functions as F

from tillweave.catalog import QUERIES
from tillweave.operators.panel import trim_before_first_sale
from tillweave.operators.relational import quoted
from tillweave.plans import design, interim, raw
from tillweave.sources import sample_tables as tables
from tillweave.sources import zones


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def written(spark, data_dir, tmp_path_factory):
    """Interim inputs as files, as in production."""
    root = str(tmp_path_factory.mktemp("inputs"))
    parts = {
        "sales": tables.sales_long(spark, data_dir),
        "prodloc": tables.prodloc(spark, data_dir),
        "calendar": tables.calendar(spark, data_dir),
    }
    for name, df in parts.items():
        df.write.parquet(f"{root}/{name}")
    return {name: spark.read.parquet(f"{root}/{name}") for name in parts}


def test_flagging_shuffles_once(written):
    plan = plan_of(interim.sales_interim(written["sales"]))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert "Join" not in plan


def test_bucketed_panel_is_not_shuffled(spark, written, tmp_path):
    """Trimming, flags and a join by id of a panel in buckets, read by this session and by one that did not write it."""
    root = str(tmp_path)
    zones.write_bucketed(written["sales"], ["id"], 4, root, "2.raw", "sales", sort_by=["id", "date"])
    zones.write_bucketed(written["prodloc"], ["id"], 4, root, "2.raw", "prodloc")
    want = interim.sales_interim(written["sales"])
    for session in (spark, spark.newSession()):
        for known in session.catalog.listTables(pattern="bucketed_*"):  # as in a session that starts with an empty catalog
            session.sql(f"DROP TABLE {known.name}")
        sales, prodloc = (zones.read_bucketed(session, root, "2.raw", name) for name in ("sales", "prodloc"))
        flagged = interim.sales_interim(sales)
        joined = flagged.join(prodloc.hint("merge"), "id")
        assert "Exchange" not in plan_of(flagged) and "Exchange" not in plan_of(joined)
        assert joined.count() == want.count()
        assert sorted(map(tuple, flagged.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert sales.count() == zones.read_latest(spark, root, "2.raw", "sales").count()


def test_melt_has_no_shuffle(spark, data_dir, written):
    plan = plan_of(raw.sales_raw(tables.sales_wide(spark, data_dir), written["calendar"]))
    assert "Exchange hashpartitioning" not in plan
    assert "BroadcastHashJoin" in plan


def test_design_matrix_broadcasts_small_sides(written):
    sales = interim.sales_interim(written["sales"])
    regressors = written["calendar"].select(
        "date", F.lit("CA").alias("state_id"), F.col("wday").alias("trend")
    )
    plan = plan_of(design.design_matrix(sales, written["prodloc"], regressors))
    assert "SortMergeJoin" not in plan
    assert plan.count("BroadcastHashJoin") == 2


def test_registered_design_matrix_shuffles_the_panel_once(spark, data_dir):
    plan = plan_of(QUERIES["design_matrix"](spark, data_dir))
    assert not re.findall(r"Exchange hashpartitioning\(date\S*, state_id", plan)


def test_filters_and_columns_reach_the_scan(spark, data_dir):
    df = tables.table(spark, data_dir, "lineitem").where(F.col("l_quantity") > 10).select("l_orderkey")
    plan = plan_of(df)
    assert "GreaterThan(l_quantity,10.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_trim_shuffles_once(written):
    plan = plan_of(trim_before_first_sale(written["sales"]))
    assert plan.count("Exchange hashpartitioning") == 1


def test_quoting():
    assert quoted("Mother's day") == "`Mother's day`"
