"""A second run writes nothing; a run that lost a step goes on with it."""

import pytest
from pyspark.sql import functions as F

from tillweave.plans import runner
from tillweave.sources import sample_tables as tables
from tillweave.sources.sample_tables import EVENT_NAMES
from tillweave.sources.zones import is_bucketed, read_latest, write_bucketed


@pytest.fixture(scope="module")
def inputs(spark, data_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("external"))
    parts = {"sales_long": tables.sales_long, "prodloc": tables.prodloc, "calendar": tables.calendar, "prices": tables.sell_prices}
    for name, build in parts.items():
        build(spark, data_dir).write.parquet(f"{folder}/{name}")
    return runner.Inputs(event_names=EVENT_NAMES, **{name: spark.read.parquet(f"{folder}/{name}") for name in parts})


def test_only_what_changed_is_made_again(spark, inputs, tmp_path, monkeypatch):
    root = str(tmp_path)

    def lost(*_):
        raise RuntimeError("executors are gone")

    with monkeypatch.context() as patched:
        patched.setattr(runner.design, "regressor_table", lost)
        with pytest.raises(RuntimeError, match="gone"):
            runner.build_all(spark, root, inputs, 0.001, version="may")
    rest = runner.build_all(spark, root, inputs, 0.001, version="may")
    assert rest == [("3.interim", "regressor_table"), ("4.processed", "designmatrix")]
    before = read_latest(spark, root, "4.processed", "designmatrix").agg(F.count(F.lit(1)), F.sum("sales")).first()
    assert runner.build_all(spark, root, inputs, 0.001, version="may") == []
    # Another threshold concerns the flags and what is made of them; the raw zone and the features stay.
    again = runner.build_all(spark, root, inputs, 0.01, version="may")
    assert ("3.interim", "sales") in again and ("4.processed", "designmatrix") in again
    assert not [pair for pair in again if pair[0] == "2.raw"]
    assert read_latest(spark, root, "4.processed", "designmatrix").agg(F.count(F.lit(1)), F.sum("sales")).first() == before
    assert runner.raw_steps(inputs)[0].name == "prodloc_raw"
    with pytest.raises(ValueError, match="give sales_wide"):
        runner.raw_steps(runner.Inputs(inputs.calendar, inputs.prices, EVENT_NAMES))


def test_buckets_change_the_layout_and_no_row(spark, inputs, tmp_path):
    plain, dealt = str(tmp_path / "plain"), str(tmp_path / "dealt")
    assert runner.build_all(spark, plain, inputs, 0.001) == runner.build_all(spark, dealt, inputs, 0.001, buckets=4)
    sizes = [sorted(map(tuple, runner.row_counts(spark, root, runner.DATA_SETS).collect())) for root in (plain, dealt)]
    assert sizes[0] == sizes[1]
    for name in ("sales_raw", "sales", "designmatrix"):
        zone = runner.ZONE_OF[name]
        assert is_bucketed(spark, dealt, zone, name) and not is_bucketed(spark, plain, zone, name)
    a, b = (read_latest(spark, root, "3.interim", "sales") for root in (plain, dealt))
    assert a.exceptAll(b).count() == 0
    with pytest.raises(ValueError, match="at least one bucket"):
        write_bucketed(a, [], 4, dealt, "2.raw", "x")


def test_zones_are_built_from_one_reading_of_the_order_lines(spark, tmp_path, monkeypatch):
    from tillweave.catalog import pipelines

    root, base = str(tmp_path), "/root/testdata/sf0.001"
    lines, parts = (spark.read.parquet(f"{base}/{n}.parquet") for n in ("lineitem", "part"))
    odd = lines.limit(2).withColumn("l_partkey", F.lit(-1).cast("long"))  # no part, but they count for the dates
    odd = odd.withColumn("l_shipdate", F.col("l_shipdate") + F.expr("interval 20 years"))
    without = lines.limit(5).withColumn("l_quantity", F.lit(None).cast("double"))
    lines.unionByName(odd).unionByName(without).write.parquet(f"{root}/lineitem.parquet")
    parts.withColumn("p_brand", F.when(F.col("p_partkey") % 50 != 0, F.col("p_brand"))).write.parquet(f"{root}/part.parquet")

    seen = []
    monkeypatch.setattr(pipelines.runner, "build_all", lambda spark, folder, inputs, threshold: seen.append(inputs))
    pipelines.built_zones(spark, root)
    for name, make in (("sales_long", tables.sales_long), ("prodloc", tables.prodloc), ("calendar", tables.calendar), ("prices", tables.sell_prices)):
        made, known = getattr(seen[0], name), make(spark, root)
        assert "l_shipdate" not in made._jdf.queryExecution().toString()
        assert made.dtypes == known.dtypes
        assert made.exceptAll(known).isEmpty() and known.exceptAll(made).isEmpty() and not known.isEmpty()
