"""New log files normalised, searched for attacks and listed as jobs as they arrive."""

from pyspark.sql import functions as F

from wardlog import fixed_values as fixed
from wardlog.operators.detect import all_alerts
from wardlog.operators.formats import SAMPLE_LINES, detect_format
from wardlog.operators.normalize import BROADCAST_FILES, formats_present
from wardlog.operators.rollups import write_rollup
from wardlog.plans.analyze import job_table, line_counts, normalize_files
from wardlog.schema import ENTRY_SCHEMA
from wardlog.session import require_utc
from wardlog.sources.lines import clean_lines, count_splits, extension_glob, number_rows, pin_splits
from wardlog.sources.waf_csv import mark_irregular


def ingest_stream(spark, in_dir, out_dir, checkpoint, hint=None, assume_year=2026, files_per_batch=1000,
                  alerts_dir=None, jobs_dir=None, thresholds=None, owner=None, rollup_dir=None, **trigger):
    """Start the query that normalises new files below ``in_dir`` into ``out_dir``.

    A file is always read whole within one micro-batch and is a job of its own.
    With ``alerts_dir`` the detectors run over the stored entries of each batch,
    which therefore hold its jobs whole; with ``jobs_dir`` every file with a line
    gets its row in the job table, and with ``rollup_dir`` the counts of the batch
    are kept for dashboards (see rollups). Each micro-batch overwrites folders of its own,
    so a batch that is run again after a failure leaves no duplicates. Runs until
    the present files are done unless another trigger is given.
    """
    require_utc(spark)
    pin_splits(spark)
    stream = (
        spark.readStream.format("text")
        .option("pathGlobFilter", extension_glob())
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(in_dir)
        .select(
            "value",
            F.col("_metadata.file_path").alias("source_file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("_metadata.file_size").alias("file_size"),
        )
    )

    def save(batch, batch_id):
        rows = batch.withColumn("row_id", F.monotonically_increasing_id())
        # one row per split and per file, used several times
        splits = count_splits(rows, *line_counts(), F.max("file_size").alias("file_size")).persist()
        numbered = number_rows(rows, splits, written=True, keep_block=True)
        formats = mark_irregular(detect_format(clean_lines(numbered, max_lines=SAMPLE_LINES), hint), splits).persist()
        folder = lambda table: f"{table}/batch_id={batch_id}"
        # a batch holds at most files_per_batch files, each with one row of formats
        few = files_per_batch <= BROADCAST_FILES
        # only the formats that occur: with all of them the plan outgrows what the JVM compiles
        present = formats_present(formats) or [fixed.JSON]
        entries, counted = normalize_files(numbered, splits, formats, assume_year=assume_year, few=few, present=present)
        entries.write.mode("overwrite").parquet(folder(out_dir))
        stored = spark.read.schema(ENTRY_SCHEMA).parquet(folder(out_dir))
        if alerts_dir is not None:
            all_alerts(stored, thresholds).write.mode("overwrite").parquet(folder(alerts_dir))
        if jobs_dir is not None:
            files = splits.groupBy("source_file").agg(F.max("file_size").alias("file_size"))
            jobs = job_table(files, counted, formats, stored, owner=owner)
            jobs.write.mode("overwrite").parquet(folder(jobs_dir))
        if rollup_dir is not None:
            write_rollup(stored, rollup_dir, batch_id)
        splits.unpersist()
        formats.unpersist()

    return (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
