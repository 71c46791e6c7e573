"""What grows with the input: rows of a task, files of a batch, what a plan holds."""

from pyspark.sql import functions as F

from wardlog import fixed_values as fixed
from wardlog.plans import fixtures as fx
from wardlog.schema import ENTRY_SCHEMA
from wardlog.sources.tables import read_entries, write_entries
from wardlog.streaming import ingest

LINE = '10.0.0.{n} - - [10/Mar/2026:10:00:0{n} +0000] "GET /x HTTP/1.1" 200 5 "-" "ua"'


def test_batch_of_many_files_gives_few_files_and_its_own_formats(spark, tmp_path, monkeypatch):
    """Each file is a job; the entries of a batch must not be one folder per job, nor its plan hold every format."""
    seen, inner = [], ingest.normalize_files
    monkeypatch.setattr(
        ingest, "normalize_files", lambda *a, **named: seen.append(named.get("present")) or inner(*a, **named)
    )
    source = tmp_path / "in"
    source.mkdir()
    for n in range(9):
        (source / f"{n}.log").write_text(LINE.format(n=n) + "\n")
    ingest.ingest_stream(spark, str(source), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert seen == [[fixed.ACCESS]]
    assert not list((tmp_path / "out").rglob("job_id=*"))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == found.select("job_id").distinct().count() == 9
    assert spark.read.schema(ENTRY_SCHEMA).parquet(str(tmp_path / "out")).select("job_id").distinct().count() == 9


def test_rows_of_one_row_group_are_dealt_to_tasks(spark, tmp_path):
    """The number of rows sets the number of tasks, however the file was written; equal rows and null keys stay."""
    n = 2 * fx.ROWS_PER_TASK + 1
    events = spark.range(n, numPartitions=1).selectExpr(
        "if(id % 3 = 0, null, id % 5) event_id", "timestamp_ntz '2024-01-01 00:00:00' ts", "id % 7 user_id", "'view' event_type",
        "1.0d value", "'{\"k\": 1}' props",
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    rows = fx.source_rows(spark, str(tmp_path))
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 3 and sum(sizes) == n and max(sizes) < n / 2
    assert rows.filter("event_id is null").count() == -(-n // 3)


def test_entries_are_written_without_a_sort_and_beyond_the_open_files(spark, tmp_path):
    """Tasks keep the files of a few jobs open instead of sorting whole raw lines; more jobs than that are written too."""
    open_files = int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters"))
    assert open_files > 0
    jobs = 3 * open_files
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in ENTRY_SCHEMA if f.name not in ("job_id", "line_number", "raw_line")]
    rows = spark.range(10 * jobs, numPartitions=1).select(
        F.concat(F.lit("j"), (F.col("id") % jobs).cast("string")).alias("job_id"), F.col("id").alias("line_number"),
        F.concat(F.lit("line "), F.col("id").cast("string")).alias("raw_line"), *columns,
    )
    path = str(tmp_path / "entries")
    write_entries(rows.select(ENTRY_SCHEMA.names), path)
    found = read_entries(spark, path).select("job_id", "line_number", "raw_line")
    assert found.exceptAll(rows.select(found.columns)).count() == 0 and found.count() == 10 * jobs


def test_mixed_files_make_their_lines_in_a_projection(spark, tmp_path):
    """The generator only unpacks an array; expressions behind it would be interpreted row by row."""
    spark.range(3).selectExpr(
        "id event_id", "timestamp_ntz '2024-01-01 00:00:00' ts", "id user_id", "'view' event_type", "1.0d value", "'{\"k\": 1}' props",
    ).write.parquet(str(tmp_path / "events.parquet"))
    lines = fx.mixed_files(spark, str(tmp_path))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    generator = next(line for line in plan.splitlines() if "Generate explode" in line)
    assert "junk line" not in generator
    assert lines.count() == 3 * len(fx.MIXED_FORMS) + 1
