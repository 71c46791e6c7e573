"""Entry and alert tables as Parquet, one folder per job."""

from pyspark.sql import functions as F

from wardlog.schema import ALERT_SCHEMA, ENTRY_SCHEMA, JOB_SCHEMA

RAW_LINE_LIMIT = 2000


def _write_by_job(table, path, mode):
    """Overwriting replaces the folders of the jobs in ``table`` and keeps all others."""
    writer = table.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("job_id").parquet(path)


def write_entries(entries, path, mode="append", raw_chars=None):
    """Save entries; the raw line is kept whole, or cut to its first ``raw_chars`` characters where that is given.

    Rows stay in the tasks that parsed them: no shuffle, and a large job is
    written by many tasks.
    """
    if raw_chars:
        entries = entries.withColumn("raw_line", F.substring("raw_line", 1, raw_chars))
    _write_by_job(entries, path, mode)


def read_entries(spark, path):
    return spark.read.schema(ENTRY_SCHEMA).parquet(path)


def write_alerts(alerts, path, mode="append"):
    _write_by_job(alerts, path, mode)


def write_jobs(jobs, path, mode="append"):
    _write_by_job(jobs, path, mode)


def read_jobs(spark, path):
    return spark.read.schema(JOB_SCHEMA).parquet(path)


def read_alerts(spark, path):
    return spark.read.schema(ALERT_SCHEMA).parquet(path)
