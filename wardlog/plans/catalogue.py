"""Queries registered for checking: name -> function of (spark, folder of the test tables)."""

from functools import wraps

from pyspark.sql import functions as F

from wardlog.functions.ip import is_public_ip
from wardlog.functions.times import plain_text
from wardlog.operators import dashboard as dash
from wardlog.operators import evidence, rollups, search
from wardlog.operators.detect import DETECTOR_FUNCTIONS, run_all
from wardlog.operators.detect_brute_force import burst_targets as burst_target_rows
from wardlog.operators.detect_brute_force import find_bursts, success_after
from wardlog.operators.detect_web import match_attack_categories
from wardlog.operators.formats import detect_format
from wardlog.operators.normalize import (
    BROADCAST_FILES, formats_present, normalize, normalize_access, normalize_auth, normalize_firewall,
    normalize_json, normalize_nginx_error, parse_stats,
)
from wardlog.operators.normalize_waf import normalize_waf
from wardlog.operators.normalize_web import classify_request
from wardlog.operators.reputation import enrich_ips, public_ips, records_at, reputation_band
from wardlog.operators.timeline import filter_timeline, timeline, timeline_types
from wardlog.operators.years import with_years
from wardlog.plans import fixtures as fx
from wardlog.plans.analyze import analyze, current
from wardlog.session import prepare, scratch_path
from wardlog.sources.lines import list_log_files, read_log_lines
from wardlog.sources.tables import RAW_LINE_LIMIT, read_alerts, read_entries, write_alerts, write_entries
from wardlog.sources.waf_csv import read_waf_csv
from wardlog.streaming.ingest import ingest_stream
from wardlog.streaming.rate import stream_rate

QUERIES = {}


def query(function):
    """Register under the function's name."""

    @wraps(function)
    def run(spark, sf_dir):
        return function(prepare(spark), str(sf_dir).rstrip("/"))

    QUERIES[function.__name__] = run
    return run


def alert_query(function):
    """Register over the alerts of all detectors."""

    def run(spark, sf_dir):
        return function(spark, sf_dir, fx.alert_fixture(spark, sf_dir))

    run.__name__ = function.__name__
    query(run)
    return function


def seconds_text(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def extra(key):
    return F.element_at("extra_fields", key).alias(key)


def entry_columns(*names):
    """Compared entry columns; both times as text."""
    return [
        "job_id", "line_number", seconds_text("event_time").alias("event_time"),
        seconds_text("event_time_local").alias("event_time_local"), "event_type", *names,
    ]


def fact(path, kind="string"):
    return F.get_json_object("evidence", f"$.{path}").cast(kind).alias(path)


def numbers_text(path):
    """A JSON list of numbers as text without brackets."""
    return F.regexp_replace(F.get_json_object("evidence", f"$.{path}"), r"[\[\]]", "").alias(path)


# --- normalisers -------------------------------------------------------------------


@query
def normalize_auth_lines(spark, sf_dir):
    entries = normalize_auth(fx.rendered_lines(spark, sf_dir, "auth"), assume_year=2024)
    return entries.select(
        *entry_columns("username", "source_ip", "message", extra("hostname"), extra("service"), extra("command"))
    )


@query
def normalize_auth_over_years(spark, sf_dir):
    """Login logs in text files, an event an hour, over turns of the year and a leap day. Each file begins in a known year."""
    path = scratch_path(spark, "years")
    at = F.expr(f"timestamp_ntz '{fx.FIRST_HOUR}' + make_dt_interval(0, cast(event_id as int))")
    rows = fx.source_rows(spark, sf_dir).withColumn("event_time_local", at)
    line = F.concat(
        F.date_format("event_time_local", "MMM d HH:mm:ss"), F.lit(" e"), F.col("event_id").cast("string"),
        F.lit(" sshd[1]: Failed password for root from 10.0.0.1 port 22 ssh2"),
    )
    rows.repartitionByRange("event_id").sortWithinPartitions("event_id").select(line.alias("value")).write.text(path)
    lines = read_log_lines(spark, path)
    event_id = F.regexp_extract("raw_line", r" e(\d+) ", 1).cast("int")
    first = lines.groupBy("source_file").agg(F.min(event_id).alias("first_id"))
    began = F.expr(f"year(timestamp_ntz '{fx.FIRST_HOUR}' + make_dt_interval(0, first_id))")
    entries = normalize_auth(with_years(lines.join(first, "source_file"), began), assume_year=F.col("log_year"))
    return entries.select(
        extra("hostname"), seconds_text("event_time").alias("event_time"), "event_type",
        F.dayofyear("event_time_local").alias("day"),
    )


@query
def normalize_access_lines(spark, sf_dir):
    entries = normalize_access(fx.rendered_lines(spark, sf_dir, "access"))
    return entries.select(
        *entry_columns(
            "username", "source_ip", "endpoint", "method", "status_code", "response_size", "user_agent", "message",
            extra("referrer"), extra("protocol"),
        )
    )


@query
def normalize_nginx_error_lines(spark, sf_dir):
    lines = fx.rendered_lines(spark, sf_dir, "error").withColumn(
        "raw_line", F.when(F.col("line_number") % 5 == 0, "not an error line").otherwise(F.col("raw_line"))
    )
    return normalize_nginx_error(lines).select(*entry_columns("source_ip", "message", extra("level"), extra("pid")))


@query
def normalize_json_lines(spark, sf_dir):
    entries = normalize_json(fx.rendered_lines(spark, sf_dir, "json"))
    return entries.select(
        *entry_columns("username", "source_ip", "endpoint", "status_code", "message", extra("k"))
    )


@query
def json_times_of_many_forms(spark, sf_dir):
    """JSON lines whose times take a form by their number, from fixtures.TIME_FORMS."""
    form = F.col("event_id") % len(fx.TIME_FORMS)
    told = fx.case([(form == i, F.date_format("event_time_local", f)) for i, f in enumerate(fx.TIME_FORMS)])
    lines = fx.source_rows(spark, sf_dir).select(
        F.lit("all").alias("job_id"), F.lit("all.log").alias("source_file"), (F.col("event_id") + 1).alias("line_number"),
        F.to_json(F.struct(told.alias("time"), F.lit("x").alias("event"))).alias("raw_line"),
    )
    return normalize_json(lines).select("line_number", seconds_text("event_time_local").alias("event_time"))


def _firewall(spark, sf_dir, form, *extras):
    entries = normalize_firewall(fx.rendered_lines(spark, sf_dir, form), assume_year=2024)
    return entries.select(*entry_columns("source_ip", "destination_ip", "message", *[extra(e) for e in extras]))


@query
def normalize_firewall_iptables(spark, sf_dir):
    return _firewall(spark, sf_dir, "kernel", "action", "protocol", "source_port", "destination_port",
                     "interface_in", "interface_out", "hostname")


@query
def normalize_firewall_pf(spark, sf_dir):
    return _firewall(spark, sf_dir, "pf", "action", "direction", "interface", "source_port", "destination_port")


@query
def normalize_firewall_kv(spark, sf_dir):
    return _firewall(spark, sf_dir, "pairs", "ACTION", "SRC", "DST", "K")


def _waf_columns():
    return entry_columns(
        "source_ip", "endpoint", "method", "message", extra("host"), extra("country"), extra("action"),
        extra("terminating_rule"),
    )


@query
def normalize_waf_rows(spark, sf_dir):
    return normalize_waf(fx.waf_rows(spark, sf_dir)).select(*_waf_columns())


@query
def read_waf_files(spark, sf_dir):
    """The same rows through CSV files, every tenth with line breaks in a cell; numbering is per file, so the row is
    found by its host cell."""
    path = scratch_path(spark, "waf-csv")
    broken = F.concat(F.lit("/a\n\nb,"), F.col("line_number").cast("string"))
    rows = fx.waf_rows(spark, sf_dir)
    rows = rows.withColumn("URI", F.when(F.col("line_number") % 10 == 0, broken).otherwise(F.col("URI")))
    rows.withColumn("host", F.concat("host", F.lit('"'), "line_number")).drop("job_id", "line_number").write.option(
        "header", True
    ).option("quote", '"').option("escape", '"').csv(path)
    entries = normalize_waf(read_waf_csv(spark, path, job_id="all"))
    cell = F.element_at("extra_fields", "host")
    return entries.select(
        F.substring_index(cell, '"', -1).cast("long").alias("row"), seconds_text("event_time").alias("event_time"),
        "event_type", "source_ip", "endpoint", "message",
    )


@query
def classify_requests(spark, sf_dir):
    c = fx.fixture_columns()
    rows = fx.source_rows(spark, sf_dir).select(
        c["status_code"].alias("status"), c["method"].alias("method"),
        F.when(F.col("k") % 6 == 0, "/Login").when(F.col("k") % 6 == 1, "/x/ADMIN/y")
        .otherwise(F.coalesce(c["endpoint"], F.lit("/"))).alias("path"),
    )
    kind = classify_request(F.col("status"), F.col("method"), F.col("path"))
    return rows.groupBy(kind.alias("event_type"), "status", "method").agg(F.count(F.lit(1)).alias("requests"))


@query
def detect_file_formats(spark, sf_dir):
    return detect_format(fx.mixed_files(spark, sf_dir)).select(
        "source_file", "format", F.bround("score", 6).alias("score")
    )


@query
def hinted_file_formats(spark, sf_dir):
    """Every third file comes with a hint in capitals, every third with an unknown word."""
    number = F.regexp_extract("source_file", r"(\d+)", 1).cast("long")
    hint = F.when(number % 3 == 0, "NGINX").when(number % 3 == 1, "hearsay")
    return detect_format(fx.mixed_files(spark, sf_dir), hint).select(
        "source_file", "format", F.bround("score", 6).alias("score")
    )


@query
def normalize_mixed_files(spark, sf_dir):
    """All formats in one pass, counted per file and event type."""
    lines = fx.mixed_files(spark, sf_dir)
    stored = scratch_path(spark, "formats")
    detect_format(lines).write.parquet(stored)
    formats = spark.read.parquet(stored)
    few = formats.count() <= BROADCAST_FILES
    entries = normalize(lines, formats, assume_year=2024, small_formats=few, present=formats_present(formats))
    return entries.groupBy("job_id", "event_type").agg(
        F.count(F.lit(1)).alias("entries"), F.count("source_ip").alias("with_ip")
    )


@query
def parse_statistics(spark, sf_dir):
    lines = fx.rendered_lines(spark, sf_dir, "access").withColumn(
        "raw_line", F.when(F.col("line_number") % 5 == 0, "junk").otherwise(F.col("raw_line"))
    )
    return parse_stats(normalize_access(lines), lines)


@query
def read_text_files(spark, sf_dir):
    """Lines through text files: each file holds a run of events, so its line numbers
    differ from the event ids by one amount per file."""
    path = scratch_path(spark, "text")
    c = fx.fixture_columns()
    rows = fx.source_rows(spark, sf_dir).select(
        "event_id", F.concat_ws(" ", F.col("event_id").cast("string"), fx.line_texts()["access"]).alias("value")
    )
    rows.repartitionByRange("event_id").sortWithinPartitions("event_id").select(
        F.concat(F.lit("  "), F.col("value"), F.lit("\t")).alias("value")
    ).write.text(path)
    lines = read_log_lines(spark, path).withColumn(
        "event_id", F.substring_index("raw_line", " ", 1).cast("long")
    )
    first = lines.groupBy("source_file").agg(F.min("event_id").alias("first_id"))
    return lines.join(first, "source_file").select(
        "event_id", "raw_line",
        (F.col("line_number") - (F.col("event_id") - F.col("first_id"))).alias("first_line"),
    )


@query
def listed_files(spark, sf_dir):
    """Every second job's lines are written with an accepted extension, the rest without."""
    path = scratch_path(spark, "listed")
    lines = fx.rendered_lines(spark, sf_dir, "access").select("raw_line")
    lines.write.text(path)
    lines.write.option("header", True).csv(f"{path}/sub")
    return list_log_files(spark, path).groupBy("extension").agg((F.sum("file_size") > 0).alias("has_data"))


def _long_lines(spark, sf_dir):
    """Entries whose raw lines are longer than RAW_LINE_LIMIT."""
    return fx.log_fixture(spark, sf_dir).withColumn(
        "raw_line", F.concat("message", F.repeat(F.lit("x"), RAW_LINE_LIMIT))
    )


@query
def stored_entries(spark, sf_dir):
    """Entries written per job and read back, their raw lines cut as on the sync route."""
    path = scratch_path(spark, "entries")
    write_entries(_long_lines(spark, sf_dir), path, raw_chars=RAW_LINE_LIMIT)
    return read_entries(spark, path).select(
        *entry_columns("source_ip", "endpoint", "response_size", F.length("raw_line").alias("raw_length")),
        F.element_at("extra_fields", "terminating_rule").alias("rule"),
    )


@query
def stored_whole_lines(spark, sf_dir):
    """Entries written as by default, which keeps their raw lines whole."""
    path = scratch_path(spark, "entries")
    write_entries(_long_lines(spark, sf_dir), path)
    return read_entries(spark, path).select(
        *entry_columns(F.length("raw_line").alias("raw_length"), F.sha2("raw_line", 256).alias("raw_sha256"))
    )


@query
def stored_alerts(spark, sf_dir):
    """Alerts written per job and read back."""
    path = scratch_path(spark, "stored-alerts")
    write_alerts(fx.alert_fixture(spark, sf_dir), path)
    return read_alerts(spark, path).select(
        "job_id", "detector", "severity", "source_ip", "target_account", "title", "description",
        seconds_text("created_at").alias("created_at"), F.array_join("recommended_actions", "|").alias("actions"),
    )


@query
def analyzed_files(spark, sf_dir):
    """Access logs, one of two folders with a blank in its name, and CSV exports with line breaks
    in their cells, all of one job that is analysed a second time when the exports have come."""
    base = scratch_path(spark, "analyzed")
    lines = fx.rendered_lines(spark, sf_dir, "access")
    odd = F.col("line_number") % 2 == 1
    lines.filter(odd).select("raw_line").write.text(f"{base}/in/a b")
    lines.filter(~odd).select("raw_line").write.text(f"{base}/in/c")
    job = lambda: analyze(spark, f"{base}/in", f"{base}/out", "all", assume_year=2024, thresholds=fx.THRESHOLDS)
    job()
    uri = F.when(F.col("line_number") % 10 == 0, F.concat(F.lit("/"), "URI", F.lit("\n,"), "line_number")).otherwise(F.col("URI"))
    exports = fx.waf_rows(spark, sf_dir).withColumn("URI", uri).drop("job_id", "line_number")
    exports.write.option("header", True).option("quote", '"').option("escape", '"').csv(f"{base}/in/waf")
    job()
    entries, alerts, jobs = current(spark, f"{base}/out")
    counted = lambda rows, kind, name: rows.groupBy(F.lit(kind).alias("kind"), name.alias("name")).agg(
        F.count(F.lit(1)).alias("n")
    )
    broken = F.when(F.contains("endpoint", F.lit("\n")), "broken").otherwise("whole")
    return (
        counted(entries, "entries", F.concat_ws(" ", "event_type", broken))
        .unionByName(counted(alerts, "alerts", F.concat_ws(" ", "severity", "title")))
        .unionByName(jobs.select(F.lit("lines").alias("kind"), F.col("log_type").alias("name"), F.col("total_lines").alias("n")))
        .unionByName(jobs.select(F.lit("parsed").alias("kind"), F.col("job_id").alias("name"), F.col("parsed_lines").alias("n")))
    )


# --- detectors -----------------------------------------------------------------------


def _alerts(spark, sf_dir, detector):
    return DETECTOR_FUNCTIONS[detector](fx.log_fixture(spark, sf_dir), **fx.THRESHOLDS.get(detector, {}))


@query
def brute_force(spark, sf_dir):
    return _alerts(spark, sf_dir, "brute_force").select(
        "job_id", "source_ip", "severity", "target_account", fact("failed_attempts", "long"),
        fact("duration_seconds", "double"), fact("first_attempt"), fact("last_attempt"),
        fact("success_after_failures"), numbers_text("sample_lines"),
    )


@query
def burst_targets(spark, sf_dir):
    """The names that each burst tried, one in a row."""
    return burst_target_rows(fx.log_fixture(spark, sf_dir), **fx.THRESHOLDS["brute_force"])


@query
def success_after_burst(spark, sf_dir):
    entries = fx.log_fixture(spark, sf_dir)
    bursts = success_after(entries, find_bursts(entries, **fx.THRESHOLDS["brute_force"]))
    return bursts.filter("success").select(
        "job_id", "source_ip", "count", plain_text(F.timestamp_micros("last_us")).alias("last_attempt")
    )


@query
def off_hours_login(spark, sf_dir):
    return _alerts(spark, sf_dir, "off_hours_login").select(
        "job_id", "source_ip", "target_account", "severity", "description", fact("hour", "int"),
        fact("line_number", "long"), fact("login_time"),
    )


@query
def multi_privileged(spark, sf_dir):
    return _alerts(spark, sf_dir, "multi_privileged").select(
        "job_id", "source_ip", "severity", "target_account", "description", fact("login_count", "long"),
    )


@query
def login_after_failures(spark, sf_dir):
    return _alerts(spark, sf_dir, "login_after_failures").select(
        "job_id", "source_ip", "target_account", "title", fact("failure_count", "long"), fact("success_time"),
        fact("line_number", "long"),
    )


@query
def attack_categories(spark, sf_dir):
    return match_attack_categories(fx.log_fixture(spark, sf_dir)).select("job_id", "line_number", "category")


@query
def attack_categories_in_pages(spark, sf_dir):
    """The signatures over whole page texts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", F.lit(None).cast("string").alias("endpoint"), F.col("html").alias("message"),
        F.lit("").alias("raw_line"),
    )
    return match_attack_categories(pages).select("page_id", "category")


@query
def web_attacks(spark, sf_dir):
    return _alerts(spark, sf_dir, "web_attacks").select(
        "job_id", "source_ip", "severity", "title", fact("attempt_count", "long"), numbers_text("sample_lines"),
        F.array_join(F.from_json(F.get_json_object("evidence", "$.sample_endpoints"), "array<string>"), "|")
        .alias("sample_endpoints"),
    )


@query
def rate_abuse(spark, sf_dir):
    return _alerts(spark, sf_dir, "rate_abuse").select(
        "job_id", "source_ip", "severity", fact("peak_rate_per_minute", "long"), fact("total_requests", "long"),
        fact("window_start"), fact("window_end"),
    )


@query
def exfiltration(spark, sf_dir):
    tops = F.from_json(F.get_json_object("evidence", "$.top_endpoints"), "array<struct<endpoint:string,bytes:bigint>>")
    return _alerts(spark, sf_dir, "exfiltration").select(
        "job_id", "source_ip", "severity", "description", fact("total_bytes", "long"), fact("total_mb", "double"),
        fact("request_count", "long"),
        F.array_join(F.transform(tops, lambda t: F.concat_ws("=", t["endpoint"], t["bytes"])), ",")
        .alias("top_endpoints"),
    )


@query
def error_flood(spark, sf_dir):
    return _alerts(spark, sf_dir, "error_flood").select(
        "job_id", "source_ip", "severity", "description", fact("total_errors", "long"),
        fact("status_distribution"),
    )


@query
def all_detectors(spark, sf_dir):
    alerts = run_all(fx.log_fixture(spark, sf_dir), fx.THRESHOLDS)
    return alerts.select("job_id", "detector", "alert_type", "severity", "severity_rank", "source_ip", "title")


# --- dashboard -------------------------------------------------------------------------


def _over_entries(function):
    def run(spark, sf_dir):
        return function(fx.log_fixture(spark, sf_dir))

    run.__name__ = function.__name__
    return query(run)


for _metric in (
    dash.dash_scalars, dash.top_ips, dash.top_endpoints, dash.top_users, dash.events_by_hour, dash.waf_actions,
    dash.waf_by_hour, dash.top_blocked_ips, dash.top_blocked_endpoints, dash.top_rules,
):
    _over_entries(_metric)


@alert_query
def alerts_by_severity(spark, sf_dir, alerts):
    return dash.alerts_by_severity(alerts)


@alert_query
def alerts_by_type(spark, sf_dir, alerts):
    return dash.alerts_by_type(alerts)


@alert_query
def severity_distribution(spark, sf_dir, alerts):
    return dash.severity_distribution(alerts, fx.job_fixture(spark, sf_dir))


def _as_texts(wide):
    """The wide row per job; lists as text, so that they compare as values."""

    def as_text(field):
        names = field.dataType.elementType.names
        item = lambda s: F.concat_ws(":", *[s[n].cast("string") for n in names])
        return F.array_join(F.transform(field.name, item), ",").alias(field.name)

    return wide.select(
        *[as_text(f) if f.dataType.typeName() == "array" else F.col(f.name) for f in wide.schema]
    )


@alert_query
def dashboard(spark, sf_dir, alerts):
    return _as_texts(dash.dashboard(fx.log_fixture(spark, sf_dir), alerts))


def _rollups(spark, entries):
    """Rollups of three batches of entries, the second of which comes twice."""
    folder = scratch_path(spark, "rollups")
    for batch in (0, 1, 1, 2):
        rollups.write_rollup(entries.filter(F.col("line_number") % 3 == batch), folder, batch)
    return folder


@query
def dashboard_from_rollups(spark, sf_dir):
    """The entries are written first: detectors and batches read them eleven times."""
    entries = fx.stored_fixture(spark, sf_dir)
    alerts = fx.alert_fixture(spark, sf_dir, entries)
    return _as_texts(rollups.dashboard_of_rollups(spark, _rollups(spark, entries), alerts))


@query
def estimated_addresses(spark, sf_dir):
    """Distinct addresses by merged sketches, within five per cent of the exact number."""
    entries = fx.stored_fixture(spark, sf_dir)
    exact = dash.dash_scalars(entries).select("job_id", "unique_ips")
    near = F.abs(F.col("estimated_ips") - F.col("unique_ips")) <= 0.05 * F.col("unique_ips")
    estimated = rollups.estimated_addresses(spark, _rollups(spark, entries))
    return exact.join(estimated, "job_id").select("job_id", "unique_ips", near.alias("within_bound"))


# --- search, alerts, jobs, time line --------------------------------------------------------


@query
def search_entries(spark, sf_dir):
    found = search.search_entries(
        fx.log_fixture(spark, sf_dir), page=2, page_size=50, event_type="login_failed", search="API%error"
    )
    return found.select("job_id", "line_number", "message", "username")


@query
def search_deep_page(spark, sf_dir):
    """A page behind the rows that are taken from the top."""
    found = search.search_entries(fx.log_fixture(spark, sf_dir), page=60, page_size=50, deep_rows=100, search="api")
    return found.select("job_id", "line_number", "message")


@query
def search_count(spark, sf_dir):
    return search.search_count(fx.log_fixture(spark, sf_dir), username="root", search="get _api")


@alert_query
def list_alerts(spark, sf_dir, alerts):
    return search.list_alerts(
        alerts, fx.job_fixture(spark, sf_dir), severity="high", owner="owner0"
    ).select("job_id", "severity", "title", "source_ip", seconds_text("created_at").alias("created_at"))


@alert_query
def alert_total(spark, sf_dir, alerts):
    return search.count_alerts(alerts, fx.job_fixture(spark, sf_dir), severity="high", owner="owner0")


@query
def job_total(spark, sf_dir):
    return search.count_jobs(fx.job_fixture(spark, sf_dir), owner="owner1")


@alert_query
def filter_alerts(spark, sf_dir, alerts):
    return search.filter_alerts(alerts, "exfil").select("job_id", "alert_type", "title")


@alert_query
def list_jobs(spark, sf_dir, alerts):
    jobs = search.job_summary(fx.job_fixture(spark, sf_dir), alerts)
    return search.list_jobs(jobs, page=1, page_size=2).withColumn(
        "created_at", plain_text(F.col("created_at").cast("timestamp_ntz"))
    )


@query
def scope_to_owner(spark, sf_dir):
    return search.scope_to_owner(fx.job_fixture(spark, sf_dir), "owner1").select("job_id", "created_by_user_id")


def _timeline(spark, sf_dir, alerts):
    return timeline(fx.log_fixture(spark, sf_dir), alerts, limit=200)


@alert_query
def timeline_events(spark, sf_dir, alerts):
    events = _timeline(spark, sf_dir, alerts)
    return events.withColumn("timestamp", plain_text(F.col("timestamp").cast("timestamp_ntz")))


@alert_query
def timeline_event_types(spark, sf_dir, alerts):
    return timeline_types(_timeline(spark, sf_dir, alerts))


@alert_query
def timeline_of_type(spark, sf_dir, alerts):
    return filter_timeline(_timeline(spark, sf_dir, alerts), "invalid_user").select("job_id", "place", "username")


# --- evidence and risk ------------------------------------------------------------------------


@query
def event_type_distribution(spark, sf_dir):
    return evidence.event_type_distribution(fx.log_fixture(spark, sf_dir))


@alert_query
def alert_digest(spark, sf_dir, alerts):
    return evidence.alert_digest(alerts)


@query
def notable_sample(spark, sf_dir):
    return evidence.notable_sample(fx.log_fixture(spark, sf_dir))


@alert_query
def evidence_pack(spark, sf_dir, alerts):
    return evidence.evidence_pack(fx.log_fixture(spark, sf_dir), alerts, fx.job_fixture(spark, sf_dir))


@alert_query
def job_risk(spark, sf_dir, alerts):
    return evidence.job_risk(alerts, fx.job_fixture(spark, sf_dir))


@alert_query
def job_recommendations(spark, sf_dir, alerts):
    return evidence.job_recommendations(alerts)


# --- reputation ---------------------------------------------------------------------------------


@query
def public_addresses(spark, sf_dir):
    return public_ips(fx.public_entries(spark, sf_dir))


@query
def public_address_tests(spark, sf_dir):
    """Every address block decided: the four octets vary with the event."""
    rows = fx.source_rows(spark, sf_dir)
    octet = lambda c, m: (c % m).cast("string")
    ip = F.concat_ws(
        ".", octet(F.col("event_id"), 256), octet(F.col("event_id") * 7 + F.col("k"), 256),
        octet(F.col("k"), 5), octet(F.col("user_id"), 256),
    )
    return rows.select("event_id", ip.alias("ip")).withColumn("public", is_public_ip(F.col("ip")))


@query
def enriched_addresses(spark, sf_dir):
    return enrich_ips(
        public_ips(fx.public_entries(spark, sf_dir)), fx.abuse_fixture(spark, sf_dir), fx.vt_fixture(spark, sf_dir),
        F.lit(fx.LOOKUP_NOW).cast("timestamp"), ttl_seconds=86400,
    ).select(
        "ip", F.col("abuseipdb.abuse_confidence_score").alias("score"), F.col("abuseipdb.total_reports").alias("reports"),
        F.col("virustotal.malicious").alias("malicious"), F.col("virustotal.harmless").alias("harmless"),
    )


@query
def reputation_at_event(spark, sf_dir):
    """The check of an address that was valid when the event happened; every seventh event is a check too."""
    events = fx.public_entries(spark, sf_dir)
    checks = events.filter("event_id % 7 = 0").groupBy(F.col("source_ip").alias("ip"), F.col("event_time").alias("checked_at")).agg(
        F.max(F.col("event_id") % 101).alias("score")
    )
    return records_at(events, checks, ttl_seconds=86400).select("event_id", F.col("record.score").alias("score"))


@query
def reputation_bands(spark, sf_dir):
    return fx.abuse_fixture(spark, sf_dir).groupBy(
        reputation_band(F.col("abuse_confidence_score")).alias("band")
    ).agg(F.count(F.lit(1)).alias("addresses"))


# --- streaming -------------------------------------------------------------------------------------


@query
def ingested_stream(spark, sf_dir):
    """Access-log files taken in by the streaming job, counted per event type."""
    base = scratch_path(spark, "stream")
    fx.rendered_lines(spark, sf_dir, "access").select("raw_line").write.text(f"{base}/in")
    ingest_stream(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("event_type", "method").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("response_size").alias("bytes")
    )


@query
def ingested_alerts(spark, sf_dir):
    """Access-log files of 200 lines, each a job, taken in by several micro-batches: in how many
    jobs a detector raised an alert about an address."""
    base = scratch_path(spark, "stream")
    rows = fx.source_rows(spark, sf_dir).withColumn("file", F.floor(F.col("event_id") / fx.FILE_LINES))
    lines = rows.select("file", fx.line_texts()["access"].alias("raw_line"))
    lines.repartition("file").write.partitionBy("file").text(f"{base}/in")
    files = list_log_files(spark, f"{base}/in").count()
    ingest_stream(
        spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", files_per_batch=max(1, files // 2),
        alerts_dir=f"{base}/alerts", thresholds={"exfiltration": {"threshold_mb": 10}, "error_flood": {"threshold": 2}},
    ).awaitTermination()
    alerts = spark.read.parquet(f"{base}/alerts")
    return alerts.groupBy("detector", "source_ip").agg(F.count_distinct("job_id").alias("jobs"))


@query
def streamed_rate(spark, sf_dir):
    """Window counts of the entry stream over several micro-batches, whose files hold mixed times, so
    that later batches bring entries of earlier windows; every window's last count is kept."""
    base = scratch_path(spark, "rate")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3, "event_id").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    rates = stream_rate(fx.entries_of(fx.shaped(stream)), "1 day", "12 hours")

    def save(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    rates.writeStream.outputMode("update").foreachBatch(save).option(
        "checkpointLocation", f"{base}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    return (
        spark.read.parquet(f"{base}/out")
        .groupBy("job_id", "source_ip", "window_start")
        .agg(F.max_by("requests", "batch_id").alias("requests"))
        .withColumn("window_start", seconds_text("window_start"))
    )
