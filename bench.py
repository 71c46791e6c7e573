"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the folder of the test tables, BENCH_CPUS the cores. Besides the
registered queries on stored entries, lineitem is rendered as about one access-log
line per row and taken through reading, format detection, normalising, storing and
all detectors.
"""

import json
import os
import time

from pyspark.sql import functions as F

from wardlog.operators.detect import all_alerts
from wardlog.plans.analyze import analyze
from wardlog.plans.catalogue import QUERIES
from wardlog.session import build_session, scratch_path
from wardlog.sources.lines import read_log_lines
from wardlog.sources.tables import read_entries
from wardlog.operators.formats import detect_format
from wardlog.operators.normalize import formats_present, normalize

HEADLINE = [
    "normalize_auth_lines", "normalize_access_lines", "normalize_json_lines", "normalize_firewall_iptables",
    "normalize_mixed_files", "detect_file_formats", "brute_force", "login_after_failures", "multi_privileged",
    "off_hours_login", "web_attacks", "attack_categories", "rate_abuse", "exfiltration", "error_flood",
    "all_detectors", "dash_scalars", "top_endpoints", "waf_by_hour", "dashboard", "timeline_events",
    "search_entries", "evidence_pack", "enriched_addresses",
]


def access_lines(spark, sf_dir):
    """One access-log line per lineitem row."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    second = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(86400)).cast("int")
    at = F.timestamp_seconds(F.unix_seconds(F.date_trunc("day", F.col("l_shipdate").cast("timestamp"))) + second)
    status = F.when(F.col("l_returnflag") == "R", "401").when(F.col("l_quantity") < 3, "404").otherwise("200")
    return rows.select(
        F.format_string(
            '10.%d.%d.%d - user%d [%s +0000] "%s /api/part/%d HTTP/1.1" %s %d "-" "Mozilla/5.0 (X11; Linux x86_64)"',
            F.col("l_suppkey") % 7, F.col("l_suppkey") % 251, F.col("l_partkey") % 13, F.col("l_suppkey") % 97,
            F.date_format(at, "dd/MMM/yyyy:HH:mm:ss"),
            F.when(F.col("l_linestatus") == "O", "GET").otherwise("POST"), F.col("l_partkey"), status,
            F.col("l_extendedprice").cast("long"),
        ).alias("value")
    )


def timed(action):
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def run_fully(frame):
    frame.write.format("noop").mode("overwrite").save()


def normalize_files(lines):
    formats = detect_format(lines)
    return normalize(lines, formats, small_formats=True, present=formats_present(formats))


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    run_fully(QUERIES["top_ips"](spark, sf_dir))
    times = {}
    for name in HEADLINE:
        times[name] = timed(lambda: run_fully(QUERIES[name](spark, sf_dir)))

    source, out = scratch_path(spark, "bench-lines"), scratch_path(spark, "bench-out")
    access_lines(spark, sf_dir).write.text(source)
    lines = read_log_lines(spark, source, "bench")
    times["file_read_and_number"] = timed(lambda: run_fully(lines))
    times["file_normalize"] = timed(lambda: run_fully(normalize_files(lines)))
    times["file_analyze_end_to_end"] = timed(lambda: analyze(spark, source, out, "bench"))
    entries = read_entries(spark, f"{out}/entries")
    times["file_all_detectors"] = timed(lambda: run_fully(all_alerts(entries)))
    count = entries.count()
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rstrip("/").split("sf")[-1],
        "file_lines": count,
        "analyzed_lines_per_sec": round(count / times["file_analyze_end_to_end"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
