"""Spark session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


#: Spark's setting that removes the shuffle files of a query once it has ended.
FREEING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "zonecast", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; `conf` overrides any of them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        # Skips a stack capture per column expression; plans here have many.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def streaming_session(checkpoint: str, app_name: str = "zonecast-stream", **conf: str) -> SparkSession:
    """Session for the streaming job: graceful stop and a default checkpoint root."""
    return build_session(
        app_name,
        **{
            "spark.streaming.stopGracefullyOnShutdown": "true",
            "spark.sql.streaming.checkpointLocation": checkpoint,
            **conf,
        },
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by `spark.checkpoint.dir`.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local folder would be lost with its machine.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="zonecast-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh, not yet existing path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


_freeing = {"writers": 0, "before": None}
_freeing_lock = threading.Lock()


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of the queries run in here go when their query ends, not when the driver happens to collect its garbage.

    The setting is the session's: of writers side by side the last one puts it back.
    """
    with _freeing_lock:
        if not _freeing["writers"]:
            _freeing["before"] = spark.conf.get(FREEING, None)
        _freeing["writers"] += 1
        spark.conf.set(FREEING, "true")
    try:
        yield
    finally:
        with _freeing_lock:
            _freeing["writers"] -= 1
            if not _freeing["writers"]:
                spark.conf.unset(FREEING) if _freeing["before"] is None else spark.conf.set(FREEING, _freeing["before"])


def checkpointed(spark: SparkSession, df):
    """Write `df` to the shared folder and read it back, cutting its lineage.

    Parquet instead of an RDD checkpoint keeps column pruning and pushdown for
    the readers; the files survive the loss of any executor.
    """
    path = new_dir(spark, "cut")
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
