"""Errors for wrong arguments; zones and snapshots."""

import pytest
from pyspark.sql import functions as F

from tillweave.operators.relational import hash_column, join_tables, lookup_strict, sample_rows
from tillweave.operators.reshape import pivot_fill
from tillweave.sources.zones import read_latest, write_zone


@pytest.fixture
def two(spark):
    return spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")


def test_join_arguments(two):
    with pytest.raises(ValueError, match="unknown join kind"):
        join_tables(two, two, ["k"], "outside")
    with pytest.raises(ValueError, match="needs keys"):
        join_tables(two, two)
    with pytest.raises(ValueError, match="takes no keys"):
        join_tables(two, two, ["k"], "cross")


def test_pivot_arguments(two):
    for missing in ({"index": "k", "on": "v", "values": "k"}, {"index": "k", "on": "v"}, {"index": "k", "values": "v"}, {"on": "v", "values": "k"}):
        with pytest.raises(ValueError):
            pivot_fill(two, **missing)
    assert pivot_fill(two, "k", "v", "k", ["a", "b"]).orderBy("k").collect() == [(1, 1, 0), (2, 0, 2)]


def test_zone_arguments(two, spark, tmp_path):
    with pytest.raises(ValueError, match="unknown zone"):
        write_zone(two, str(tmp_path), "5.other", "t")
    with pytest.raises(ValueError, match="name"):
        write_zone(two, str(tmp_path), "2.raw")
    with pytest.raises(ValueError):
        read_latest(spark, str(tmp_path))


def test_newest_snapshot(two, spark, tmp_path):
    root = str(tmp_path)
    write_zone(two.where("k = 1"), root, "2.raw", "t", stamp="20240101_000000")
    write_zone(two, root, "2.raw", "t", stamp="20240102_000000")
    with pytest.raises(Exception):
        write_zone(two, root, "2.raw", "t", stamp="20240102_000000")
    assert read_latest(spark, root, "2.raw", "t").count() == 2
    wider = two.withColumn("extra", F.lit(1))
    write_zone(wider.limit(0), root, "2.raw", "t", stamp="20240103_000000")
    newest = read_latest(spark, root, "2.raw", "t")
    assert newest.columns == ["k", "v", "extra"] and newest.count() == 0
    assert read_latest(spark, root, "2.raw", "t", stamp="20240101_000000").collect() == [(1, "a")]


def test_lookup(two):
    assert [r[0] for r in two.orderBy("k").select(lookup_strict("v", {"a": "A", "b": "B"})).collect()] == ["A", "B"]
    soft = lookup_strict("v", {"a": "A"}, default="other", strict=False)
    assert [r[0] for r in two.orderBy("k").select(soft).collect()] == ["A", "other"]
    with pytest.raises(Exception, match="no entry for b"):
        two.select(lookup_strict("v", {"a": "A"})).collect()


def test_hash_and_sample_repeat(spark):
    ids = spark.range(1000).select(F.col("id").cast("string").alias("id"))
    hashed = hash_column(ids, "id", "h")
    assert hashed.agg(F.countDistinct("h")).first()[0] == 1000
    first = sorted(r["id"] for r in sample_rows(ids, 15, seed=1).collect())
    assert first == sorted(r["id"] for r in sample_rows(ids.repartition(7), 15, seed=1).collect())
    assert len(first) == 15
    assert first != sorted(r["id"] for r in sample_rows(ids, 15, seed=2).collect())
