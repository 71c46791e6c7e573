"""What a row costs: no sort of all rows, no search through lists row by row, no work on rows that cannot count."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wardlog import fixed_values as fixed
from wardlog.operators import dashboard as dash
from wardlog.operators import detect_abuse, rollups
from wardlog.operators.detect_web import match_attack_categories, signature
from wardlog.plans import catalogue
from wardlog.plans import fixtures as fx
from wardlog.schema import ENTRY_SCHEMA
from wardlog.sources import csv_records, lines

NAMES = ENTRY_SCHEMA.names


def entries(spark, rows):
    """Entries of one job and address; each row gives the other fields."""
    full = [{**dict.fromkeys(NAMES), "job_id": "j", "source_ip": "1.1.1.1", "line_number": n, **row} for n, row in enumerate(rows, 1)]
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in full], ENTRY_SCHEMA)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def generated(frame):
    """The expressions that a plan's generators interpret."""
    return [line for line in frame._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode" in line]


def test_activity_is_counted_in_a_hash_table(spark, tmp_path, monkeypatch):
    """Old and new counts agree for moments logged with several wall clocks, by lines without a number too."""
    monkeypatch.setattr(detect_abuse, "stored", lambda frame, name: frame)
    at = datetime(2026, 1, 1, 12)
    rng = random.Random(5)
    rows = [
        {"event_time": at + timedelta(seconds=i // 4), "event_time_local": rng.choice([None, at, at + timedelta(hours=2)]),
         "line_number": rng.choice([None, i // 3, i]), "status_code": 404, "response_size": 1}
        for i in range(80)
    ]
    found = entries(spark, rows)
    counts = detect_abuse.activity(found)
    assert "SortAggregate" not in plan_of(counts) and "HashAggregate" in plan_of(counts)
    assert not any("unix_micros" in line for line in generated(counts))
    for seconds in (1, 3, 1000):
        peak = detect_abuse.peak_rates(found, seconds, 3).first()
        moments = {}
        for r in rows:
            moments.setdefault(r["event_time"], []).append(r)
        size = lambda end: sum(len(v) for t, v in moments.items() if end - timedelta(seconds=seconds) <= t <= end)
        end = max(moments, key=lambda t: (size(t), -t.timestamp()))
        start = min(t for t in moments if t >= end - timedelta(seconds=seconds))
        low = datetime.min
        least = lambda t: min(moments[t], key=lambda r: (-1 if r["line_number"] is None else r["line_number"], r["event_time_local"] or low))
        assert (peak.peak, peak.total) == (size(end), 80)
        assert (peak.start_wall, peak.end_wall) == (least(start)["event_time_local"], least(end)["event_time_local"])


def test_marks_rule_out_no_match_of_a_signature(spark):
    """Random texts of the signatures' own pieces, other cases and letters that count as ASCII ones."""
    pieces = [
        "union", "select", "from", "drop", "table", "insert", "into", "update", "set", "or", "and", "1", "=", "'", "--", "sleep", "(",
        "waitfor", "delay", "benchmark", "0xa", "char", "concat", "<", "script", ">", "javascript", "vbscript", ":", "onload", "alert",
        "confirm", "prompt", "document.", "cookie", "write", "../", "..\\", "/etc/passwd", "/proc/self", "c:\\", "windows", "boot.ini", ";",
        "cat", "|", "id", "`", "$(", ")", "nikto", "nessus", "wp-", "admin", "xmlrpc.php", ".env", ".DS_Store", "web.config", "phpinfo",
        " ", " ", "\t", "\u2003", "\u017fcript", "\u0130d", "\u212a", "é",
    ]
    rng = random.Random(7)
    case = lambda t: rng.choice([t, t.upper(), t.title(), t.replace("s", "\u017f")])
    texts = ["".join(case(rng.choice(pieces)) for _ in range(rng.randint(1, 6))) for _ in range(4000)]
    df = entries(spark, [{"endpoint": t} for t in texts])
    plain = [F.when(F.col("endpoint").rlike(signature(c)), c) for c in fixed.ATTACK_SIGNATURES]
    want = df.select("line_number", F.explode(F.array_compact(F.array(*plain))).alias("category"))
    got = match_attack_categories(df).select("line_number", "category")
    order = lambda frame: sorted(map(tuple, frame.collect()))
    assert order(got) == order(want) and want.select("category").distinct().count() == len(fixed.ATTACK_SIGNATURES)
    assert list(fixed.ATTACK_MARKS) == list(fixed.ATTACK_SIGNATURES)
    assert not any("RLIKE" in line for line in generated(got))


def test_lines_find_their_record_without_a_search(spark, tmp_path):
    """Lines of a CSV export look bits up; a list of exceptions would be searched for each line of its run."""
    text = "a,b\n" + "".join(f'{i},"x\ny"\n' if i % 3 == 0 else f"{i},z\n\n" for i in range(700))
    (tmp_path / "f.csv").write_text(text)
    rows = lines.scan_text(spark, str(tmp_path))
    numbered = lines.number_rows(rows, lines.count_splits(rows), keep_block=True)
    records, removed = csv_records.split_records(numbered)
    assert "lambda" not in plan_of(records)
    found = sorted((r.line_number, r.value) for r in records.collect())
    assert [n for n, _ in found] == list(range(1, 702))
    assert [v for _, v in found] == ["a,b", *(f'{i},"x\ny"' if i % 3 == 0 else f"{i},z" for i in range(700))]
    assert [r.removed for r in removed.collect()] == [len(text.splitlines()) - 701]


def test_only_sampled_lines_are_stripped(spark, tmp_path):
    (tmp_path / "f.log").write_text("".join(f" line {i}\n" for i in range(9)))
    rows = lines.scan_text(spark, str(tmp_path))
    sample = lines.clean_lines(lines.number_rows(rows, lines.count_splits(rows)), "j", 4)
    below = sample._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]
    assert "trim" not in below
    assert sorted(r.raw_line for r in sample.collect()) == [f"line {i}" for i in range(4)]


def test_scans_are_cut_finer_than_the_cores(spark):
    old = spark.conf.get("spark.sql.files.minPartitionNum", None)
    spark.conf.unset("spark.sql.files.minPartitionNum")
    lines.pin_splits(spark)
    assert int(spark.conf.get("spark.sql.files.minPartitionNum")) > spark.sparkContext.defaultParallelism
    if old is not None:
        spark.conf.set("spark.sql.files.minPartitionNum", old)


def test_facets_are_paired_in_a_projection(spark):
    df = entries(spark, [{"endpoint": "/x", "event_type": "waf_block"}])
    counts = dash.facet_counts(df, list(dash.FACETS))
    assert not any("blocked_ip" in line for line in generated(counts))
    assert {tuple(r) for r in counts.collect()} == {
        ("j", "source_ip", "1.1.1.1", 1), ("j", "endpoint", "/x", 1), ("j", "blocked_ip", "1.1.1.1", 1), ("j", "blocked_endpoint", "/x", 1),
    }


def test_rollups_and_detectors_share_one_stored_fixture(spark, tmp_path, monkeypatch):
    """Rows of events are turned into entries once, and a batch's sketches come from its facets."""
    spark.range(60).selectExpr(
        "id event_id", "timestamp_ntz '2024-01-01 00:00:00' ts", "id % 7 user_id", "'purchase' event_type", "1.0d value", "'{\"k\": 1}' props",
    ).write.parquet(str(tmp_path / "events.parquet"))
    made, inner, read = [], fx.log_fixture, []
    monkeypatch.setattr(fx, "log_fixture", lambda *a: made.append(a) or inner(*a))
    write = rollups.write_rollup
    monkeypatch.setattr(rollups, "write_rollup", lambda e, *a: read.append(e.inputFiles()) or write(e, *a))
    assert catalogue.QUERIES["dashboard_from_rollups"](spark, str(tmp_path)).count() == 3
    assert len(made) == 1 and len(read) == 4 and not any("events.parquet" in f for files in read for f in files)
    assert catalogue.QUERIES["estimated_addresses"](spark, str(tmp_path)).filter("within_bound").count() == 3
    assert len(made) == 2
