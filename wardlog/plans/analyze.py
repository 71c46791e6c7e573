"""Raw log files to stored entries, alerts and jobs."""

import uuid
from collections import namedtuple

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlog import fixed_values as fixed
from wardlog.operators.detect import all_alerts
from wardlog.operators.formats import SAMPLE_LINES, detect_format
from wardlog.operators.normalize import BROADCAST_FILES, formats_present, normalize
from wardlog.operators.normalize_waf import normalize_cells
from wardlog.schema import ALERT_SCHEMA, ENTRY_SCHEMA, JOB_SCHEMA
from wardlog.session import require_utc
from wardlog.sources.lines import (
    clean_lines, cleaned, count_splits, job_of, list_log_files, number_rows, scan_text,
)
from wardlog.sources.tables import (
    read_alerts, read_entries, read_jobs, write_alerts, write_entries, write_jobs,
)
from wardlog.sources.waf_csv import mark_irregular, odd_quotes, read_cells

Analysis = namedtuple("Analysis", "entries alerts jobs")


def job_table(files, splits, formats, entries, job_id=None, owner=None):
    """One row per job: files, size, format, non-blank lines, recognised entries.

    The header of a CSV export is no line. Several formats in one job are "Mixed".
    """
    counted = splits.groupBy("source_file").agg(F.sum("filled").alias("lines"))
    files = (
        files.join(counted, "source_file", "left")
        .join(formats.select("source_file", "format"), "source_file", "left")
    )
    header = F.when(F.col("format") == fixed.WAF, 1).otherwise(0)
    jobs = files.groupBy(job_of(job_id).alias("job_id")).agg(
        # the scans escape paths; a plus sign stands for itself there
        F.min(F.url_decode(F.replace(F.substring_index("source_file", "/", -1), F.lit("+"), F.lit("%2B")))).alias("filename"),
        F.sum("file_size").alias("file_size"),
        F.min("format").alias("first_format"),
        F.max("format").alias("last_format"),
        F.sum(F.coalesce(F.col("lines") - header, F.lit(0))).alias("total_lines"),
    )
    parsed = entries.groupBy("job_id").agg(
        F.count(F.when(F.col("event_type") != "unparsed", 1)).alias("parsed_lines")
    )
    kind = F.coalesce(F.col("first_format"), F.lit(fixed.JSON))
    return jobs.join(parsed, "job_id", "left").select(
        "job_id",
        "filename",
        "file_size",
        F.when(F.col("first_format") != F.col("last_format"), "Mixed").otherwise(kind).alias("log_type"),
        F.lit("completed").alias("status"),
        "total_lines",
        F.coalesce("parsed_lines", F.lit(0)).alias("parsed_lines"),
        F.lit(owner).cast("string").alias("created_by_user_id"),
        F.current_timestamp().alias("created_at"),
    )


def line_counts():
    """Counts of a split's raw values: non-blank ones, and those with an odd number of quotes."""
    value = F.col("value")
    return F.count_if(cleaned(value) != "").alias("filled"), F.count_if(odd_quotes(value)).alias("odd")


def normalize_files(numbered, splits, formats, job_id=None, assume_year=2026, few=False, present=None):
    """Entries of all files, and the split table with the number of records as the lines of CSV exports.

    ``numbered`` has the raw values with block and line_number, ``formats`` comes from mark_irregular. CSV exports whose
    lines are not their records, because a cell holds a line break or blank lines stand between them, are read by
    records; all else is one scan.
    """
    regular, irregular = formats.filter("not irregular"), formats.filter("irregular")
    entries = normalize(clean_lines(numbered, job_id), regular, assume_year, few, present)
    most = irregular.agg(F.max(F.array_max("waf_columns"))).first()[0]
    if most is None:
        return entries, splits
    cells, removed = read_cells(numbered, formats, most, job_id)
    exports = irregular.select("source_file").distinct()
    records = splits.join(exports, "source_file", "left_semi").groupBy("source_file").agg(F.sum("in_split").alias("lines"))
    records = records.join(removed, "source_file", "left").select(
        "source_file", (F.col("lines") - F.coalesce("removed", F.lit(0))).alias("filled")
    )
    others = splits.join(exports, "source_file", "left_anti")
    return (
        entries.unionByName(normalize_cells(cells, irregular)),
        others.select("source_file", "filled").unionByName(records),
    )


def analyze(spark, paths, out_dir, job_id=None, hint=None, assume_year=2026, thresholds=None, owner=None):
    """Normalise all files, store entries, detect, store alerts and jobs; returns the
    rows of this run's jobs in the three tables. Each run writes folders of its own
    below ``out_dir``, so that earlier results stay readable and an alert that is no
    longer raised is in none of this run's; ``current`` reads every job's latest run.
    Files without a line give a job with no lines. ``hint`` is a word for all files or a
    column over source_file that gives one per file.

    Raw files are scanned three times: to count the lines of every split, for the
    formats, and to normalise. The tables of the first two are written, as the
    third needs both. The detectors read the stored entries, not the raw lines, so
    every line is parsed once and each detector reads only its columns. CSV exports
    whose lines are not their records are read once more, by records.
    """
    require_utc(spark)
    rows = scan_text(spark, paths)
    run = f"run_id=r{uuid.uuid4().hex}"
    count_splits(rows, *line_counts()).write.parquet(f"{out_dir}/splits/{run}")
    splits = spark.read.parquet(f"{out_dir}/splits/{run}")
    numbered = number_rows(rows, splits, written=True, keep_block=True)
    found = detect_format(clean_lines(numbered, job_id, SAMPLE_LINES), hint)
    mark_irregular(found, splits).write.parquet(f"{out_dir}/formats/{run}")
    formats = spark.read.parquet(f"{out_dir}/formats/{run}")
    present = formats_present(formats) or [fixed.JSON]
    few = formats.count() <= BROADCAST_FILES
    path = lambda table: f"{out_dir}/{table}/{run}"
    normal, counted = normalize_files(numbered, splits, formats, job_id, assume_year, few, present)
    write_entries(normal, path("entries"), raw_chars=None)
    entries = read_entries(spark, path("entries"))
    found = all_alerts(entries, thresholds).withColumn("created_at", F.current_timestamp())
    write_alerts(found.hint("rebalance", "job_id"), path("alerts"))
    files = list_log_files(spark, paths)
    write_jobs(job_table(files, counted, formats, entries, job_id, owner), path("jobs"))
    return Analysis(entries, read_alerts(spark, path("alerts")), read_jobs(spark, path("jobs")))


def current(spark, out_dir):
    """Entries, alerts and jobs below ``out_dir``, of every job's latest run."""
    whole = lambda table, schema: spark.read.schema(
        T.StructType([*schema.fields, T.StructField("run_id", T.StringType())])
    ).parquet(f"{out_dir}/{table}")
    jobs = whole("jobs", JOB_SCHEMA)
    latest = jobs.groupBy("job_id").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))
    pick = lambda table: table.join(latest, ["job_id", "run_id"], "left_semi").drop("run_id")
    return Analysis(pick(whole("entries", ENTRY_SCHEMA)), pick(whole("alerts", ALERT_SCHEMA)), pick(jobs))
