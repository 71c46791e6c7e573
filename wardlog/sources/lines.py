"""Text log files as numbered lines."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlog.fixed_values import LOG_EXTENSIONS
from wardlog.functions.text import strip
from wardlog.session import stored

# Rows of the split table that are broadcast; a row (path and three numbers) takes a few hundred bytes.
BROADCAST_SPLITS = 500_000
# splits of a file scan per core, so that cores that are done early find more to read
SPLITS_PER_CORE = 4


def _any_case(word):
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


def extension_glob():
    """Path filter for the accepted file types, in any letter case."""
    return "*.{" + ",".join(_any_case(e) for e in LOG_EXTENSIONS) + "}"


def list_log_files(spark, paths):
    """Accepted log files below ``paths`` with their size; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", extension_glob())
        .option("recursiveFileLookup", "true")
        .load(paths)
    )
    return files.select(
        F.col("_metadata.file_path").alias("source_file"),  # as the text scans name it
        F.col("length").alias("file_size"),
        F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"),
    )


def pin_splits(spark):
    """Keep the split size of file scans fixed for the session.

    Without a setting it follows the number of cores at the moment a scan starts,
    so two scans of the same files could be cut differently while executors come
    and go; line numbering needs them cut alike.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(SPLITS_PER_CORE * spark.sparkContext.defaultParallelism))


def with_split_position(scan, columns):
    """Columns of a file scan, its split (source_file, block) and row_id in task order."""
    return scan.select(
        *columns,
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row_id"),
    )


def count_splits(rows, *counts):
    """One row per file split: how many rows it holds, its first row_id, further counts."""
    return rows.groupBy("source_file", "block").agg(
        F.count(F.lit(1)).alias("in_split"), F.min("row_id").alias("first_id"), *counts
    )


def number_rows(rows, splits, written=False, keep_block=False):
    """Add ``line_number`` (from 1, in file order) to the rows of a splittable file scan.

    ``rows`` comes from with_split_position, ``splits`` from count_splits of the
    same rows. Prefix sums over the splits of a file shift row_id, so no file is
    sorted or passed through one task. The table with one row per split is written
    first, unless it is ``written`` already, and broadcast if it has at most
    BROADCAST_SPLITS rows; beyond that the join is left to Spark.
    """
    splits = splits if written else stored(splits, "splits")
    earlier = (
        Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = splits.select(
        "source_file",
        "block",
        (F.coalesce(F.sum("in_split").over(earlier), F.lit(0)) - F.col("first_id") + 1).alias("shift"),
    )
    if splits.count() <= BROADCAST_SPLITS:
        shifts = F.broadcast(shifts)
    unknown = F.raise_error(F.lit("a file was cut differently in two scans; its lines cannot be numbered"))
    return (
        rows.join(shifts, ["source_file", "block"], "left")
        .withColumn(
            "line_number",
            F.when(F.col("shift").isNull(), unknown.cast("bigint")).otherwise(F.col("row_id") + F.col("shift")),
        )
        .drop("row_id", "shift", *([] if keep_block else ["block"]))
    )


def job_of(job_id):
    """Given job id, or one job per file."""
    return F.md5(F.col("source_file")) if job_id is None else F.lit(job_id)


def scan_text(spark, paths):
    """Raw values of text log files with their split position."""
    pin_splits(spark)
    scan = (
        spark.read.option("pathGlobFilter", extension_glob())
        .option("recursiveFileLookup", "true")
        .text(paths)
    )
    return with_split_position(scan, ["value"])


def read_log_lines(spark, paths, job_id=None, max_lines=None):
    """Lines of text log files: (job_id, source_file, line_number, raw_line).

    Invalid UTF-8 is replaced, numbering counts blank lines, which are then
    dropped. Without ``job_id`` every file is a job of its own.
    """
    rows = scan_text(spark, paths)
    return clean_lines(number_rows(rows, count_splits(rows)), job_id, max_lines)


def cleaned(value):
    """Raw value to line text."""
    return strip(F.make_valid_utf8(value))


def clean_lines(numbered, job_id=None, max_lines=None):
    """Numbered raw values to stripped, non-blank lines; of each file up to line ``max_lines``, beyond which none is
    stripped."""
    text = cleaned(F.col("value"))
    lines = numbered.select(
        job_of(job_id).alias("job_id"),
        "source_file",
        "line_number",
        (F.when(F.col("line_number") <= max_lines, text) if max_lines else text).alias("raw_line"),
    )
    return lines.filter(F.col("raw_line") != "")
