"""Test tables, and tables written to the shared folder."""

import tempfile
import uuid


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def shared_path(spark, name):
    """A fresh path all executors can reach.

    That is below spark.checkpoint.dir of the session. Where it is unset, a cluster uses the warehouse, which is
    shared as well, and a local session, which has no other machine, a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.split("[")[0] == "local"
        base = tempfile.gettempdir() if local else spark.conf.get("spark.sql.warehouse.dir") + "/scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(frame, name, *partition_by):
    """The rows written to the shared folder and read again: later steps neither recompute them nor
    depend on an executor that may be lost."""
    path = shared_path(frame.sparkSession, name)
    writer = frame.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
