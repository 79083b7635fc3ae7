"""Zone storage: every data set keeps its snapshots under one folder.

Layout ``<root>/<zone>/<name>/snapshot=<stamp>/part-*.parquet``. The newest
snapshot is the largest stamp, and only its folder is read. A snapshot that is
dealt to buckets has a note ``<name>/_layouts/<stamp>`` that says by what.
"""

from __future__ import annotations

import hashlib
import re
from datetime import datetime, timezone
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.operators.relational import quoted

# The four zones, in processing order.
ZONES = ("1.external", "2.raw", "3.interim", "4.processed")

_LAYOUT = "buckets int, keys array<string>, sorting array<string>"

# Parquet block size in bytes; small enough for many readers per file.
ROW_GROUP_BYTES = 64 * 1024 * 1024


def zone_path(root: str, zone: str, name: str | None, subfolder: str | None = None) -> str:
    """Folder of a data set; raises ValueError for an unknown zone or no name."""
    if name is None:
        raise ValueError("a data set name is needed")
    if zone not in ZONES:
        raise ValueError(f"unknown zone {zone!r}, expected one of {ZONES}")
    return "/".join([root.rstrip("/"), zone, *([subfolder] if subfolder else []), name])


def new_stamp() -> str:
    """Snapshot stamp that sorts by time."""
    return datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")


def write_zone(
    df: DataFrame,
    root: str,
    zone: str = "1.external",
    name: str | None = None,
    subfolder: str | None = None,
    stamp: str | None = None,
    sort_by: list[str] | None = None,
) -> str:
    """Write one snapshot and return its stamp. An existing snapshot is an error."""
    folder = zone_path(root, zone, name, subfolder)
    stamp = stamp or new_stamp()
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    (
        df.write.mode("errorifexists")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .parquet(f"{folder}/snapshot={stamp}")
    )
    return stamp


def write_bucketed(
    df: DataFrame,
    by: list[str],
    buckets: int,
    root: str,
    zone: str = "1.external",
    name: str | None = None,
    subfolder: str | None = None,
    stamp: str | None = None,
    sort_by: list[str] | None = None,
) -> str:
    """Write one snapshot dealt by key to ``buckets`` files, each sorted, and return its stamp.

    Rows are shuffled once here, to the tasks that own the buckets. Jobs that read it by ``read_bucketed`` and group,
    join or open windows by the key need no further shuffle of it. Two tables with equal buckets join in place. Null
    keys share a bucket.
    """
    if buckets < 1 or not by:
        raise ValueError("at least one bucket and one key are needed")
    folder, stamp = zone_path(root, zone, name, subfolder), stamp or new_stamp()
    place, order = f"{folder}/snapshot={stamp}", list(sort_by or by)
    (
        df.repartition(buckets, *by)
        .write.mode("errorifexists")
        .format("parquet")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("path", place)
        .bucketBy(buckets, *by)
        .sortBy(*order)
        .saveAsTable(_table_name(place))
    )
    note = df.sparkSession.createDataFrame([(buckets, list(by), order)], _LAYOUT)
    note.coalesce(1).write.mode("overwrite").json(f"{folder}/_layouts/{stamp}")
    return stamp


def _table_name(place: str) -> str:
    return "bucketed_" + hashlib.md5(place.encode()).hexdigest()


def read_bucketed(
    spark: SparkSession,
    root: str,
    zone: str = "3.interim",
    name: str | None = None,
    subfolder: str | None = None,
    stamp: str | None = None,
) -> DataFrame:
    """The newest snapshot of a bucketed data set, or the one named by ``stamp``, with its buckets known to Spark.

    Any session can read it: the files are entered in its catalog, under a name made from their place, as an external table.
    """
    folder = zone_path(root, zone, name, subfolder)
    stamp = stamp or newest_stamp(spark, folder)
    place = f"{folder}/snapshot={stamp}"
    if not spark.catalog.tableExists(_table_name(place)):
        note = spark.read.schema(_LAYOUT).json(f"{folder}/_layouts/{stamp}").first()
        columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in spark.read.parquet(place).schema.fields)
        keys, order = (", ".join(quoted(c) for c in note[part]) for part in ("keys", "sorting"))
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {_table_name(place)} ({columns}) USING parquet"
            f" CLUSTERED BY ({keys}) SORTED BY ({order}) INTO {note['buckets']} BUCKETS LOCATION '{place}'"
        )
    return spark.table(_table_name(place))


def is_bucketed(spark: SparkSession, root: str, zone: str, name: str, subfolder: str | None = None) -> bool:
    """Whether the newest snapshot of a data set is dealt to buckets."""
    folder = zone_path(root, zone, name, subfolder)
    try:
        spark.read.schema(_LAYOUT).json(f"{folder}/_layouts/{newest_stamp(spark, folder)}")
    except AnalysisException:  # no such note
        return False
    return True


def newest_stamp(spark: SparkSession, folder: str) -> str:
    """Stamp of the newest snapshot; raises ValueError if there is none."""
    stamps = snapshot_stamps(spark, folder)
    if not stamps:
        raise ValueError(f"no snapshot in {folder}")
    return stamps[-1]


def snapshot_stamps(spark: SparkSession, folder: str) -> list[str]:
    """Stamps of a data set, oldest first, from the names of its files alone."""
    files = spark.read.schema("snapshot string").parquet(folder).inputFiles()
    return sorted({unquote(m[1]) for f in files if (m := re.search(r"/snapshot=([^/]+)/", f))})


def read_latest(
    spark: SparkSession,
    root: str,
    zone: str | None = None,
    name: str | None = None,
    subfolder: str | None = None,
    stamp: str | None = None,
) -> DataFrame:
    """The newest snapshot of a data set, or the one named by ``stamp``.

    Only that snapshot's folder is read, so columns are its own, whatever
    older or newer snapshots hold. Raises ValueError without a place or a
    snapshot.
    """
    if zone is None and subfolder is None:
        raise ValueError("give a zone or a subfolder")
    folder = zone_path(root, zone or "3.interim", name, subfolder)
    stamp = stamp or newest_stamp(spark, folder)
    return spark.read.parquet(f"{folder}/snapshot={stamp}")


def scan_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a parquet file or folder, with a declared schema if one is given."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def inline_table(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A small table from literals."""
    return spark.createDataFrame(rows, schema)


def date_spine(spark: SparkSession, start: Column | str, end: Column | str) -> DataFrame:
    """One row per day from start to end as column ``date``."""
    lo = F.to_date(F.lit(start)) if isinstance(start, str) else start
    hi = F.to_date(F.lit(end)) if isinstance(end, str) else end
    days = F.sequence(lo, hi, F.expr("interval 1 day"))
    return spark.range(1, numPartitions=1).select(F.explode(days).alias("date"))
