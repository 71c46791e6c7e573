"""Web-firewall CSV exports."""

from pyspark.sql import functions as F

from wardlog import fixed_values as fixed
from wardlog.sources.csv_records import read_records, record_cells, split_records
from wardlog.sources.lines import count_splits, extension_glob, job_of, number_rows, pin_splits, with_split_position


def odd_quotes(value):
    """Whether a record may go on in the next line: the line holds an odd number of quotes."""
    return (F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))) % 2 == 1


def read_waf_csv(spark, paths, job_id=None):
    """Rows of CSV exports sharing one header, with line_number = row number from 2.

    All files are split, also those in which a quoted cell holds a line break.
    """
    pin_splits(spark)
    reader = spark.read.option("pathGlobFilter", extension_glob())
    header = reader.option("header", True).option("quote", '"').option("escape", '"').csv(paths).columns
    rows = with_split_position(reader.text(paths), ["value"])
    records = read_records(number_rows(rows, count_splits(rows), keep_block=True))
    cells = record_cells(records.filter("line_number > 1"), len(header))
    return cells.select(
        *[F.get("waf_cells", F.lit(i)).alias(name) for i, name in enumerate(header)],
        "source_file", "line_number", job_of(job_id).alias("job_id"),
    )


def mark_irregular(formats, splits):
    """formats with ``irregular``: whether the file is a CSV export whose lines are not its records, because a record may
    span lines or blank lines stand between them.

    ``splits`` counts the rows (in_split), the non-blank ones (filled) and those with an odd number of quotes (odd) of
    every split.
    """
    counted = splits.groupBy("source_file").agg(
        ((F.sum("odd") > 0) | (F.sum("in_split") > F.sum("filled"))).alias("uneven")
    )
    export = F.col("format") == fixed.WAF
    return formats.join(counted, "source_file", "left").withColumn(
        "irregular", export & F.coalesce("uneven", F.lit(False))
    ).drop("uneven")


def read_cells(numbered, formats, columns, job_id=None):
    """The first ``columns`` cells of every record of the irregular exports, which may differ in their headers:
    (job_id, source_file, line_number, waf_cells); a header is line 1. With them, how many lines of a file begin no
    record: (source_file, removed).

    ``numbered`` has the raw values of all files with block and line_number.
    """
    chosen = formats.filter("irregular").select("source_file").distinct()
    records, removed = split_records(numbered.join(chosen, "source_file", "left_semi"))
    cells = record_cells(records, columns)
    return cells.select(job_of(job_id).alias("job_id"), "source_file", "line_number", "waf_cells"), removed
