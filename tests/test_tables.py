import json
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scenarios import PATIENT_TRIES, SPRAYED, SPRAYER, access_scenario, auth_scenario
from test_detect import entries
from test_normalize import WAF_TEXT
from wardlog.functions.ip import canonical_ip, is_public_ip
from wardlog.functions.text import spaced_json
from wardlog.functions.times import as_instant
from wardlog.operators import dashboard as dash
from wardlog.operators import evidence, search
from wardlog.operators.detect import all_alerts
from wardlog.operators.normalize import normalize_auth
from wardlog.operators.reputation import enrich_ips, public_ips, reputation_band
from wardlog.operators.timeline import filter_timeline, timeline, timeline_types
from wardlog.plans.analyze import analyze, current
from wardlog.sources.tables import RAW_LINE_LIMIT, read_entries, write_entries
from wardlog.streaming.ingest import ingest_stream
from wardlog.streaming.rate import stream_rate

NOW = datetime(2026, 3, 12)


@pytest.fixture(scope="module")
def stored(spark):
    rows = [
        ("auth", "auth", n, line) for n, line in enumerate(auth_scenario().splitlines(), 1)
    ]
    lines = spark.createDataFrame(rows, "job_id string, source_file string, line_number long, raw_line string")
    found = normalize_auth(lines).cache()
    alerts = all_alerts(found, created_at=F.lit(NOW)).cache()
    jobs = spark.createDataFrame(
        [("auth", "ann", NOW), ("none", "bob", NOW + timedelta(days=1))],
        "job_id string, created_by_user_id string, created_at timestamp",
    )
    return found, alerts, jobs


def test_dashboard_row(spark, stored):
    found, alerts, _ = stored
    row = dash.dashboard(found, alerts).first()
    assert (row.total_events, row.total_alerts, row.critical_alerts, row.high_alerts, row.low_alerts) == (36, 4, 1, 2, 1)
    assert (row.failed_logins, row.successful_logins, row.unique_ips, row.error_rate) == (30, 3, 3, 0.0)
    assert row.top_source_ips[0].asDict() == {"ip": SPRAYER, "count": SPRAYED + 1}
    assert [h.hour for h in row.events_by_hour] == [13, 14, 23]
    assert [h.hour for h in row.waf_events_by_hour] == list(range(24)) and not row.waf_has_data
    assert {a.type: a["count"] for a in row.alerts_by_type} == {"brute_force": 1, "suspicious_login": 2, "web_attack": 1}
    assert [(s.severity, s["count"]) for s in row.severity_distribution] == [
        ("info", 0), ("low", 1), ("medium", 0), ("high", 2), ("critical", 1),
    ]


def test_dashboard_waf_lists(spark):
    rows = [
        {"event_type": "waf_block", "source_ip": f"1.1.1.{i % 12}", "endpoint": f"/{i % 3}", "second": i * 600,
         "extra_fields": {"terminating_rule": "r" * 130 if i % 2 else ""}, "status_code": 403 if i % 3 else None}
        for i in range(48)
    ] + [{"event_type": "waf_count", "second": 5}] * 2 + [{"event_type": "waf_allow", "second": 5}] * 3
    df = entries(spark, rows)
    row = dash.dashboard(df, all_alerts(df, detectors=["off_hours_login"])).first()
    assert [(a.action, a["count"]) for a in row.waf_action_counts] == [("BLOCK", 48), ("ALLOW", 3), ("COUNT", 2)]
    assert row.waf_events_by_hour[0].asDict() == {"hour": 0, "total": 11, "blocked": 6, "allowed": 3, "counted": 2}
    assert row.waf_events_by_hour[23]["total"] == 0 and len(row.top_blocked_ips) == 10
    assert [(e.endpoint, e["count"]) for e in row.top_blocked_endpoints] == [("/0", 16), ("/1", 16), ("/2", 16)]
    assert [(r.rule, r["count"]) for r in row.top_terminating_rules] == [("r" * 120, 24)]
    assert row.error_rate == 60.38 and row.total_alerts == 0
    alone = {r.hour: r.total for r in dash.waf_by_hour(df).collect()}
    assert alone == {h.hour: h.total for h in row.waf_events_by_hour}
    assert {r.action: r["count"] for r in dash.waf_actions(df).collect()} == {"BLOCK": 48, "ALLOW": 3, "COUNT": 2}


def test_search(spark, stored):
    found, alerts, jobs = stored
    page = search.search_entries(found, page=2, page_size=10, event_type="login_failed").collect()
    assert [r.line_number for r in page] == list(range(11, 21))
    assert search.search_count(found, search="FAILED%svc1").first().total == 10
    assert search.list_alerts(alerts, jobs, severity="high").count() == 2
    assert search.list_alerts(alerts, jobs, owner="bob").count() == 0
    assert search.filter_alerts(alerts, "brute").count() == 1
    assert [r.job_id for r in search.list_jobs(jobs).collect()] == ["none", "auth"]
    assert {r.job_id: r.alert_count for r in search.job_summary(jobs, alerts).collect()} == {"auth": 4, "none": 0}
    assert {r.job_id: r.risk_level for r in evidence.job_risk(alerts, jobs).collect()} == {"auth": "critical", "none": "info"}


def test_timeline(spark, stored):
    found, alerts, _ = stored
    events = timeline(found, alerts, limit=20).collect()
    assert len(events) == 20 and events[0].total == 24
    assert [e.event_type for e in events[:2]] == ["login_failed", "login_failed"]
    late = timeline(found, alerts).collect()
    assert late[-1].event_type == "alert_web_attack" and late[0].total == 35 + 4
    assert filter_timeline(timeline(found, alerts), "alert_brute_force").count() == 1
    assert timeline_types(timeline(found, alerts)).first().event_type == "alert_brute_force"


def test_evidence(spark, stored):
    found, alerts, _ = stored
    packs = evidence.evidence_pack(found, alerts).collect()
    assert len(packs) == 1
    text = packs[0].text
    assert text.startswith("Log Type: unknown\nTotal Log Entries: 36\n\nEvent Type Distribution:\n  login_failed: 30\n")
    assert f"\n\nTop Source IPs:\n  {SPRAYER}: {SPRAYED + 1} events\n" in text
    assert f"\n\nTop Usernames:\n  mara: {PATIENT_TRIES + 3} events\n" in text
    assert f"\n--- SECURITY ALERTS (4) ---\n\nAlert #1: [CRITICAL] Brute Force Attack from {SPRAYER}\n  Type: brute_force" in text
    assert f"\n--- SAMPLE NOTABLE ENTRIES (30) ---\n  Line 1: [2026-02-09 13:05:00] login_failed | IP: {SPRAYER} | User: svc00 | Failed" in text
    actions = evidence.job_recommendations(alerts).orderBy("alert_number", "action_number").collect()
    assert len(actions) == 5 + 2 * 4 + 5 and actions[0].action == f"Block IP address {SPRAYER} immediately"


def test_evidence_parts_hold_all_alerts(spark, monkeypatch):
    monkeypatch.setattr(evidence, "ALERTS_PER_PART", 100)
    monkeypatch.setattr(evidence, "RUN_LINES", 37)
    rows = [{"username": "root", "event_type": "login_success", "second": 0}] * 250
    df = entries(spark, rows)
    alerts = all_alerts(df, detectors=["off_hours_login"]).cache()
    packs = evidence.evidence_pack(df, alerts).orderBy("part").collect()
    assert [p.text.count("Alert #") for p in packs] == [100, 100, 50]
    assert "NOTABLE ENTRIES (30)" in packs[2].text and "NOTABLE" not in packs[0].text
    numbers = [(r.number, r.order_line) for r in evidence.numbered_alerts(alerts).collect()]
    assert sorted(numbers) == [(n, n) for n in range(1, 251)]


def test_public_addresses(spark):
    import ipaddress

    rng = random.Random(3)
    texts = [
        "8.8.8.8", " 1.1.1.1 ", "10.0.0.1", "100.64.1.1", "192.0.0.9", "192.0.0.1", "224.0.0.1", "255.255.255.255",
        "198.19.0.1", "01.2.3.4", "1.2.3", "256.1.1.1", "x", "", "::1", "::", "2001:db8::1", "2606:4700::1111",
        "fe80::1", "fc00::1", "2001:0:1::", "2001:20::5", "2001:4:112::1", "2002::1", "::ffff:8.8.8.8",
        "::ffff:10.0.0.1", "2606:4700:0:0:1:0:0:1", "2606::1:0:0:0", "1:2:3:4:5:6:7:8:9", "2606:::1",
        "2606:4700:4700::64.1.2.3", "100::1", "64:ff9b:1::1", "64:ff9b::1", "2A00:1450:4001:0808::200E",
    ]
    texts += [".".join(str(rng.randint(0, 255)) for _ in range(4)) for _ in range(200)]
    texts += [
        ":".join(f"{rng.choice([0, 0, rng.randint(0, 65535)]):x}" for _ in range(8)) for _ in range(100)
    ]

    def expected(text):
        try:
            address = ipaddress.ip_address(text.strip())
        except ValueError:
            return (False, None)
        return (address.is_global, str(address))

    df = spark.createDataFrame([(t,) for t in texts], "ip string")
    got = df.select("ip", is_public_ip(F.col("ip")).alias("p"), canonical_ip(F.col("ip")).alias("c")).collect()
    wrong = [
        (r.ip, r.p, r.c, expected(r.ip)) for r in got
        if (r.p, r.c if "." not in str(expected(r.ip)[1]) else expected(r.ip)[1]) != expected(r.ip)
    ]
    assert not wrong


def test_enrichment(spark):
    ips = public_ips(entries(spark, [{"source_ip": ip} for ip in ("8.8.8.8", "8.8.8.8", "10.0.0.1", "9.9.9.9", "1.1.1.1")]))
    old, new = NOW - timedelta(hours=2), NOW - timedelta(minutes=5)
    abuse = spark.createDataFrame(
        [("8.8.8.8", 10, new - timedelta(minutes=1)), ("8.8.8.8", 80, new), ("9.9.9.9", 5, old)],
        "ip string, abuse_confidence_score int, checked_at timestamp",
    )
    vt = spark.createDataFrame(
        [("8.8.8.8", 404, 7, new), ("9.9.9.9", 200, 7, new), ("1.1.1.1", 500, 7, new)],
        "ip string, http_status int, malicious int, checked_at timestamp",
    )
    got = {r.ip: r for r in enrich_ips(ips, abuse, vt, NOW).collect()}
    assert set(got) == {"8.8.8.8", "9.9.9.9", "1.1.1.1"}
    assert got["8.8.8.8"].abuseipdb.abuse_confidence_score == 80 and got["9.9.9.9"].abuseipdb is None
    assert got["8.8.8.8"].virustotal.malicious == 0 and got["9.9.9.9"].virustotal.malicious == 7
    assert got["1.1.1.1"].virustotal is None and got["1.1.1.1"].errors == ["VirusTotal: HTTP 500"]
    six = public_ips(entries(spark, [{"source_ip": "2606:4700::1"}]))
    spelled = spark.createDataFrame([("2606:4700:0::1", 9, new)], "ip string, abuse_confidence_score int, checked_at timestamp")
    assert enrich_ips(six, spelled, None, NOW).first().abuseipdb.abuse_confidence_score == 9
    bare = enrich_ips(ips).first()
    assert bare.abuseipdb is None and not bare.configured_virustotal
    bands = spark.createDataFrame([(0,), (25,), (75,)], "s int").select(reputation_band(F.col("s")).alias("b"))
    assert [r.b for r in bands.collect()] == ["green", "amber", "red"]


def test_analyze_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.log").write_text(auth_scenario())
    (source / "b.log").write_text(access_scenario())
    (source / "c.csv").write_text(WAF_TEXT)
    found, alerts, jobs = analyze(spark, str(source), str(tmp_path / "out"), owner="ann")
    assert Counter(r.job_id for r in found.select("job_id").collect()).most_common()[0][1] == 38
    assert Counter(r.severity for r in alerts.collect()) == {"critical": 1, "high": 2, "low": 5}
    evidence_of = [json.loads(r.evidence) for r in alerts.filter("detector = 'brute_force'").collect()]
    assert sorted(e["failed_attempts"] for e in evidence_of) == [12, 24]
    assert sorted((j.filename, j.log_type, j.total_lines, j.parsed_lines) for j in jobs.collect()) == [
        ("a.log", "Auth", 36, 36), ("b.log", "NginxAccess", 38, 38), ("c.csv", "AwsWafCsv", 4, 4),
    ]
    assert {j.created_by_user_id for j in jobs.collect()} == {"ann"}


# a record over two lines, blank lines within a cell and between records, another order of columns
BROKEN_EXPORTS = {
    "broken.csv": 'timestamp,action,uri,clientIp,httpMethod\n1,BLOCK,"/a ""x""\n\n/b",1.1.1.1,GET\n\n2,ALLOW,/c,1.1.1.2,GET\n',
    "gaps.csv": 'timestamp,uri,httpMethod,clientIp,action\n\n1,/d,POST,1.1.1.3,COUNT\n \n2,"/e,f",GET,1.1.1.4,ALLOW\n',
}
BROKEN_ROWS = [
    ("1.1.1.1", 2, '/a "x"\n\n/b', "waf_block"), ("1.1.1.2", 3, "/c", "waf_allow"),
    ("1.1.1.3", 2, "/d", "waf_count"), ("1.1.1.4", 3, "/e,f", "waf_allow"), ("9.9.9.9", 2, "/plain", "waf_allow"),
]


def write_exports(source):
    source.mkdir()
    for name, body in BROKEN_EXPORTS.items():
        (source / name).write_text(body)
    (source / "plain.csv").write_text("timestamp,uri,httpMethod,clientIp,action\n1,/plain,GET,9.9.9.9,ALLOW\n")
    (source / "quoted.log").write_text('{"message": "say \\"hi"}\n\n{"message": "x"}\n')


def test_exports_are_read_by_records(spark, tmp_path):
    write_exports(tmp_path / "in")
    found, _, jobs = analyze(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    rows = found.filter("event_type like 'waf%'").collect()
    assert sorted((r.source_ip, r.line_number, r.endpoint, r.event_type) for r in rows) == BROKEN_ROWS
    assert sorted((j.filename, j.total_lines, j.parsed_lines) for j in jobs.filter("log_type = 'AwsWafCsv'").collect()) == [
        ("broken.csv", 2, 2), ("gaps.csv", 2, 2), ("plain.csv", 1, 1),
    ]
    assert {j.total_lines for j in jobs.filter("filename = 'quoted.log'").collect()} == {2}
    assert sorted(r.line_number for r in found.filter("event_type not like 'waf%'").collect()) == [1, 3]


def test_streamed_exports_are_read_by_records(spark, tmp_path):
    write_exports(tmp_path / "in")
    out = lambda name: str(tmp_path / name)
    ingest_stream(spark, out("in"), out("out"), out("cp"), jobs_dir=out("jobs")).awaitTermination()
    rows = spark.read.parquet(out("out")).filter("event_type like 'waf%'").collect()
    assert sorted((r.source_ip, r.line_number, r.endpoint, r.event_type) for r in rows) == BROKEN_ROWS
    jobs = spark.read.parquet(out("jobs")).collect()
    assert sorted((j.filename, j.total_lines) for j in jobs) == [
        ("broken.csv", 2), ("gaps.csv", 2), ("plain.csv", 1), ("quoted.log", 2),
    ]


def test_analyses_share_a_folder(spark, tmp_path):
    for name in ("one", "two"):
        source = tmp_path / name
        source.mkdir(exist_ok=True)
        (source / "a.log").write_text("Mar 11 02:10:01 h CRON[1]: pam_unix(cron:session): session opened for user root")
        found, alerts, jobs = analyze(spark, str(source), str(tmp_path / "out"), job_id=name)
        assert (found.count(), alerts.count(), jobs.first().job_id) == (1, 1, name)
    for table in ("entries", "alerts", "jobs"):
        rows = spark.read.parquet(str(tmp_path / "out" / table)).collect()
        assert sorted(r.job_id for r in rows) == ["one", "two"]


def test_a_second_analysis_replaces_the_first(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    out = str(tmp_path / "out")
    (source / "a b.log").write_text("Mar 11 02:10:01 h CRON[1]: pam_unix(cron:session): session opened for user root")
    first = analyze(spark, str(source), out, job_id="j")
    assert [(j.filename, j.total_lines, j.parsed_lines) for j in first.jobs.collect()] == [("a b.log", 1, 1)] and first.alerts.count() == 1
    (source / "a b.log").write_text("Mar 11 12:10:01 h app: " + "x" * 3000)
    analyze(spark, str(source), out, job_id="j")
    entries, alerts, jobs = current(spark, out)
    assert (entries.count(), alerts.count(), jobs.count()) == (1, 0, 1)
    assert len(entries.first().raw_line) > 3000 and first.entries.count() == 1


def test_ingest_stream_takes_each_file_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    folder = lambda name: str(tmp_path / name)
    run = lambda: ingest_stream(
        spark, str(source), folder("out"), folder("cp"), alerts_dir=folder("alerts"), jobs_dir=folder("jobs"), owner="ann",
    ).awaitTermination()
    (source / "a.log").write_text(auth_scenario())
    run()
    (source / "b.log").write_text(access_scenario())
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 74 and len({r.job_id for r in rows}) == 2
    assert sorted(r.line_number for r in rows if r.status_code is None) == list(range(1, 37))
    alerts, jobs = [spark.read.parquet(folder(name)).collect() for name in ("alerts", "jobs")]
    assert Counter(r.severity for r in alerts) == {"critical": 1, "high": 2, "low": 5}
    assert sorted((j.filename, j.file_size, j.log_type, j.total_lines, j.parsed_lines) for j in jobs) == [
        ("a.log", len(auth_scenario()), "Auth", 36, 36), ("b.log", len(access_scenario()), "NginxAccess", 38, 38),
    ]
    assert {r.job_id for r in alerts} == {j.job_id for j in jobs} and {j.created_by_user_id for j in jobs} == {"ann"}


def test_late_files_count_in_the_stream(spark, tmp_path):
    out = str(tmp_path / "out")
    for name, seconds in (("1", [86400 * 9]), ("2", [5, 86400 * 9 + 1]), ("3", [6])):
        entries(spark, [{"source_ip": "1.1.1.1", "second": s} for s in seconds]).write.parquet(str(tmp_path / "made" / name))
    source = str(tmp_path / "in")
    schema = spark.read.parquet(str(tmp_path / "made" / "1")).schema
    for name in ("1", "2", "3"):  # one run for each file, the older times last
        spark.read.parquet(str(tmp_path / "made" / name)).coalesce(1).write.mode("append").parquet(source)
        rates = stream_rate(spark.readStream.schema(schema).parquet(source))
        rates.writeStream.outputMode("update").foreachBatch(
            lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch_id={n}")
        ).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("window_start").agg(F.max_by("requests", "batch_id").alias("n"))
    assert sorted(r.n for r in last.collect()) == [2, 2]


def test_evidence_text_is_spaced_and_escaped(spark):
    values = [
        {"a": [1, 2.5, None, True], "b": {"c": "x, y: z"}, "d": []}, {"q": 'say "hi", then: \\ go', "e": "z\u00fc\U0001f600"},
        {"list": ["a, b", "c:d"], "n": "x" * 600}, {"long": ["k, l"] * 200}, {},
    ]
    rows = [(i, json.dumps(v, separators=(",", ":"), ensure_ascii=False)) for i, v in enumerate(values)]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, t string").select("i", spaced_json(F.col("t"), 500).alias("t")).collect()}
    assert got == {i: json.dumps(v)[:500] for i, v in enumerate(values)}


def test_instants_do_not_follow_the_session_zone(spark):
    wall = F.lit("2026-02-09 02:14:00.000123").cast("timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.range(1).select(
            F.unix_micros(as_instant(wall)).alias("us"), F.unix_micros(as_instant(wall, F.lit(3600))).alias("east")
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    want = (datetime(2026, 2, 9, 2, 14, 0, 123) - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    assert (row.us, row.east) == (want, want - 3_600_000_000)


def test_stream_rate_on_a_table(spark):
    df = entries(spark, [{"source_ip": "1.1.1.1", "second": s} for s in (0, 10, 59, 60, 130)])
    assert sorted(r.requests for r in stream_rate(df).collect()) == [1, 1, 3]
    assert stream_rate(df, threshold=3).count() == 1


def test_entries_are_stored_whole_unless_a_cut_is_asked_for(spark, tmp_path):
    long = "GET " + "x" * RAW_LINE_LIMIT + " union select 1"
    found = entries(spark, [{"raw_line": long}, {"raw_line": "short", "second": 1}])
    write_entries(found, str(tmp_path / "whole"))
    write_entries(found, str(tmp_path / "cut"), raw_chars=RAW_LINE_LIMIT)
    lines = lambda name: sorted(r.raw_line for r in read_entries(spark, str(tmp_path / name)).collect())
    assert lines("whole") == [long, "short"]
    assert lines("cut") == [long[:RAW_LINE_LIMIT], "short"]
