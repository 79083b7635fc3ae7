"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillweave.session import scratch_folder

#: White space of every contract here: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANKS_CLASS = r"[\x20\x09-\x0D]"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    This cuts lineage, survives lost executors and gives the planner true sizes.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark, purpose)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Lower the rows an Arrow batch holds, as one text may be very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


@contextmanager
def rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs run inside, as for rows of many megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_share(doc_id: Column, parts: int) -> Column:
    """Remainder of crc32 of the id as text; null ids fall in part 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str
) -> DataFrame:
    """Apply a batch function to all rows; ``make`` builds it once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def hash_order_sample(df: DataFrame, key: Column, rows: int, count: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest key hash, spread over all data.

    ``count`` is the number of rows of ``df``: a threshold on the hash leaves a little more
    than needed, so that the ordered limit sees few rows. Repeated keys share a hash.
    """
    hashed = df.withColumn("__h", F.xxhash64(key))
    if count > 4 * rows:
        share = min(1.0, 1.5 * rows / count + 200 / count)
        low = min(2**63 - 1, -(2**63) + int(share * 2**64))
        hashed = hashed.where(F.col("__h") < F.lit(low))
    return hashed.orderBy("__h", *[F.col(c) for c in df.columns]).limit(rows).drop("__h")


def seeded(seed: int) -> np.random.Generator:
    return np.random.default_rng(seed)
