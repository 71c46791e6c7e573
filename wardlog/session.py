"""Session settings and the shared scratch folder."""

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Times are naive UTC. Generated methods above 8000 bytes of byte code are never
# compiled by the JVM, so wide projections over regular expressions run several
# times faster as separate smaller methods. A task that writes into few folders
# keeps their files open instead of sorting its rows by folder first; beyond that
# number it sorts what is left. Folders are listed by few tasks with many folders
# each, as a task costs more than a folder.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.maxConcurrentOutputFileWriters": "8",
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "96",
}
UTC_NAMES = {"UTC", "Etc/UTC", "GMT", "Z", "+00:00"}


def build_session(app="wardlog", master=None, **conf):
    """A session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        **RUNTIME_SETTINGS,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark):
    """Give a session made elsewhere the settings that can change at run time."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def require_utc(spark):
    """Naive log times count as UTC, so wall clock and instant may only differ by
    the offset written in the line."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in UTC_NAMES:
        raise ValueError(f"set spark.sql.session.timeZone to UTC (it is {zone})")


def shared_dir(spark):
    """The folder all executors can reach: the session's spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = os.path.join(tempfile.gettempdir(), f"wardlog-{os.getpid()}")
    os.makedirs(made, exist_ok=True)
    return made


def scratch_path(spark, name):
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(frame, name):
    """The rows written below the shared folder and read again, so that what follows does not compute them anew."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
