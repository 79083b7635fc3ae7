"""Session defaults and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings a job needs for right results, plus adaptive execution. Sizing
# (executors, memory, shuffle partitions) is left to the cluster.
SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app_name: str = "tillweave", **settings: str) -> SparkSession:
    """Return the running session or start one with the defaults above.

    Keyword names use ``__`` for dots: ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app_name)
    for key, value in SESSION_SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the folder the cluster names.

    The folder comes from ``spark.checkpoint.dir``. Only a local session, as in
    tests, gets a temporary folder; on a cluster a missing setting is an error
    because a machine-local folder is lost with its machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="tillweave-checkpoint-")
    context.setCheckpointDir(folder)


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for tables that one job writes and reads back.

    It lies in the shared folder that ``spark.checkpoint.dir`` names; only a
    local session gets a temporary one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return tempfile.mkdtemp(prefix=f"tillweave-{purpose}-")
