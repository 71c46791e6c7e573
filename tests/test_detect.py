import json
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

import scenarios as sc
from scenarios import access_scenario, auth_scenario
from wardlog.operators import detect, detect_abuse, detect_brute_force as brute_force_detector, detect_login
from wardlog.operators.detect import DETECTOR_FUNCTIONS, all_alerts, run_all
from wardlog.operators.detect_abuse import peak_rates
from wardlog.operators.detect_brute_force import burst_targets, detect_brute_force, find_bursts
from wardlog.operators.detect_login import failure_streaks
from wardlog.operators.detect_web import detect_web_attacks, match_attack_categories
from wardlog.operators.normalize import normalize_access, normalize_auth
from wardlog.schema import ALERT_SCHEMA, ENTRY_SCHEMA
from wardlog.session import stored

START = datetime(2026, 3, 11)


def entries(spark, rows):
    """Entries from dicts; ``second`` sets the time."""
    full = []
    for number, row in enumerate(rows, 1):
        row = dict(row)
        second = row.pop("second", None)
        when = None if second is None else START + timedelta(seconds=second)
        base = {
            "job_id": "j", "line_number": number, "event_time": when, "event_time_local": when, "raw_line": "",
        }
        full.append(tuple({**base, **row}.get(f.name) for f in ENTRY_SCHEMA))
    return spark.createDataFrame(full, ENTRY_SCHEMA).cache()


def test_auth_scenario_alerts(as_lines):
    alerts = run_all(normalize_auth(as_lines(auth_scenario())).cache()).collect()
    assert [r.severity for r in alerts] == ["critical", "high", "high", "low"]
    first = alerts[0]
    evidence = json.loads(first.evidence)
    names = [f"svc{i:02d}" for i in range(sc.SPRAYED)]
    seconds = (sc.SPRAYED - 1) * sc.SPRAY_GAP
    assert (first.source_ip, first.target_account) == (sc.SPRAYER, ", ".join(names))
    assert evidence["failed_attempts"] == sc.SPRAYED and evidence["duration_seconds"] == seconds
    assert evidence["target_accounts"] == names
    assert evidence["success_after_failures"] is True and evidence["sample_lines"] == list(range(1, 11))
    assert evidence["first_attempt"] == "2026-02-09 13:05:00" and evidence["last_attempt"] == "2026-02-09 13:07:41"
    assert f"within {seconds} seconds" in first.description and "SUCCESSFUL LOGIN" in first.description
    night = json.loads(alerts[1].evidence)
    assert (alerts[1].detector, night["line_number"], night["login_time"]) == ("off_hours_login", 34, "2026-02-09 23:30:05")
    assert (alerts[2].detector, alerts[2].title) == (
        "login_after_failures", f"Successful Login After {sc.PATIENT_TRIES} Failures for 'mara'",
    )
    assert (alerts[3].source_ip, alerts[3].title) == ("unknown", "Path Traversal Attempt from unknown")


def test_names_of_a_spray_as_rows(as_lines):
    found = normalize_auth(as_lines(auth_scenario())).cache()
    names = {f"svc{i:02d}" for i in range(sc.SPRAYED)}
    assert {(r.source_ip, r.username) for r in burst_targets(found).collect()} == {(sc.SPRAYER, n) for n in names}
    alert = detect_brute_force(found, list_targets=False).first()
    assert (alert.target_account, json.loads(alert.evidence)["target_count"]) == (None, sc.SPRAYED)
    assert f"Target accounts: {sc.SPRAYED} names." in alert.description and "svc00" not in str(alert)


def test_a_spray_without_success_is_medium(as_lines):
    alerts = run_all(normalize_auth(as_lines(auth_scenario(breached=False))).cache()).collect()
    assert [(r.severity, r.detector) for r in alerts] == [
        ("high", "off_hours_login"), ("high", "login_after_failures"), ("medium", "brute_force"), ("low", "web_attacks"),
    ]
    assert "SUCCESSFUL" not in alerts[2].description


def test_access_scenario_alerts(as_lines):
    alerts = run_all(normalize_access(as_lines(access_scenario())).cache()).collect()
    assert [(r.severity, r.title) for r in alerts] == [
        ("low", f"Brute Force Attack from {sc.REFUSED}"),
        ("low", f"Vulnerability Scanning Attempt from {sc.SCANNER}"),
        ("low", f"Cross-Site Scripting (XSS) Attempt from {sc.ATTACKER}"),
        ("low", f"Path Traversal Attempt from {sc.ATTACKER}"),
    ]
    assert [json.loads(r.evidence).get("attempt_count") for r in alerts] == [None, 3, 1, 2]


def test_alert_table_schema(as_lines):
    alerts = all_alerts(normalize_auth(as_lines(auth_scenario())))
    assert [(f.name, f.dataType.simpleString()) for f in alerts.schema] == [
        (f.name, f.dataType.simpleString()) for f in ALERT_SCHEMA
    ]


def bursts_by_loop(rows, window, threshold):
    """Plain loop: every window end in time order, first one per moment, largest kept."""
    out = {}
    groups = defaultdict(list)
    for number, (ip, second) in enumerate(rows, 1):
        groups[ip].append((second, number))
    for ip, group in groups.items():
        group.sort()
        best, seen, low = None, None, 0
        for high, (second, _) in enumerate(group):
            while second - group[low][0] > window:
                low += 1
            count = high - low + 1
            if count >= threshold and seen != second:
                seen = second
                if best is None or count > best[0]:
                    best = (count, group[low][0], second, [n for _, n in group[low:high + 1]])
        if best:
            out[ip] = best
    return out


@pytest.mark.parametrize("seed", range(3))
def test_bursts_match_loop(spark, seed):
    rng = random.Random(seed)
    rows = []
    for ip in range(60):
        hot = 300 if ip == 0 else rng.randint(1, 40)
        span = rng.choice([5, 60, 900, 20000])
        rows += [(f"ip{ip}", rng.randint(-span, span)) for _ in range(hot)]
    rng.shuffle(rows)
    df = entries(spark, [
        {"source_ip": ip, "second": s, "event_type": "login_failed", "username": f"u{n}"}
        for n, (ip, s) in enumerate(rows, 1)
    ])
    want = bursts_by_loop(rows, 300, 10)
    alerts = {r.source_ip: json.loads(r.evidence) for r in detect_brute_force(df).collect()}
    assert set(alerts) == set(want) and len(want) > 10
    for ip, (count, first, last, members) in want.items():
        got = alerts[ip]
        assert got["failed_attempts"] == count and got["duration_seconds"] == last - first
        assert got["sample_lines"] == members[:10]
        assert got["target_accounts"] == sorted(f"u{n}" for n in members)


@pytest.mark.parametrize("seed", range(3))
def test_peak_rates_match_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(f"ip{rng.randint(0, 5)}", rng.randint(0, 600) / rng.choice([1, 2, 3])) for _ in range(1500)]
    df = entries(spark, [{"source_ip": ip, "second": s} for ip, s in rows])
    groups = defaultdict(list)
    for (ip, _), row in zip(rows, df.select("event_time").collect()):
        groups[ip].append(row.event_time)
    want = {}
    for ip, times in groups.items():
        times.sort()
        low, best = 0, (0, None, None)
        for high, at in enumerate(times):
            while at - times[low] > timedelta(seconds=60):
                low += 1
            if high - low + 1 > best[0]:
                best = (high - low + 1, times[low], at)
        want[ip] = (*best, len(times))
    us = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    got = {r.source_ip: r for r in peak_rates(df, threshold=1).collect()}
    assert {ip: (r.peak, r.start_us, r.end_us, r.total) for ip, r in got.items()} == {
        ip: (n, us(a), us(b), t) for ip, (n, a, b, t) in want.items()
    }


@pytest.mark.parametrize("seed", range(3))
def test_streaks_match_loop(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(2500):
        kind = rng.choices(["login_failed", "invalid_user", "login_success", "session_opened", "access"], [6, 3, 1, 1, 2])[0]
        rows.append({
            "username": f"u{min(rng.randint(0, 9), rng.randint(0, 9))}", "event_type": kind,
            "second": rng.choice([None] + [rng.randint(0, 40000)] * 30),
        })
    want = []
    users = defaultdict(list)
    for number, row in enumerate(rows, 1):
        if row["second"] is not None and row["event_type"] != "access":
            users[row["username"]].append((row["second"], number, row["event_type"]))
    for user, events in users.items():
        streak = 0
        for _, number, kind in sorted(events):
            if kind in ("login_failed", "invalid_user"):
                streak += 1
            else:
                if streak >= 5:
                    want.append((user, number, streak))
                streak = 0
    got = [(r.username, r.line_number, r.streak) for r in failure_streaks(entries(spark, rows)).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20


def test_burst_of_one_second_counts_to_threshold(spark):
    rows = [{"source_ip": "1.1.1.1", "second": 5, "event_type": "login_failed", "username": f"u{i:02d}"} for i in range(50)]
    alert = detect_brute_force(entries(spark, rows)).first()
    evidence = json.loads(alert.evidence)
    assert evidence["failed_attempts"] == 10 and alert.severity == "low"
    assert evidence["target_accounts"] == [f"u{i:02d}" for i in range(10)]


def test_untimed_failures_form_one_burst(spark):
    rows = [{"source_ip": "1.1.1.1", "event_type": "invalid_user", "username": None} for _ in range(25)]
    rows += [{"source_ip": "1.1.1.1", "event_type": "login_success", "second": 9}]
    alert = detect_brute_force(entries(spark, rows)).first()
    evidence = json.loads(alert.evidence)
    assert evidence["failed_attempts"] == 25 and evidence["first_attempt"] is None
    assert evidence["sample_lines"] == list(range(1, 11)) and evidence["success_after_failures"] is False
    assert alert.target_account is None and "Target accounts: unknown." in alert.description
    mixed = rows[:25] + [{"source_ip": "1.1.1.1", "event_type": "invalid_user", "second": 1}]
    assert find_bursts(entries(spark, mixed)).isEmpty()


def test_categories(spark):
    cases = {
        "/q?id=1 union  select 1": {"SQL Injection"},
        "/q?x=' or '1": {"SQL Injection"},
        "/a?x=<ScRipt >": {"Cross-Site Scripting (XSS)"},
        "/a?x=..\\..\\": {"Path Traversal"},
        "/a?../x": set(),
        "/run?c=; WHOAMI": {"Command Injection"},
        "/run?c=$(x)": {"Command Injection"},
        "/wp-login.php?cat /etc/passwd": {"Vulnerability Scanning", "Path Traversal"},
        "/ok": set(),
    }
    df = entries(spark, [{"endpoint": path} for path in cases])
    got = defaultdict(set)
    for row in match_attack_categories(df).collect():
        got[row.endpoint].add(row.category)
    assert {p: got[p] for p in cases} == cases


def test_web_attack_samples_and_levels(spark):
    rows = [{"endpoint": f"/.env?{i % 3}", "source_ip": "1.1.1.1"} for i in range(200)]
    rows += [{"message": "x" * 150 + "/etc/passwd"}] * 3
    alerts = {r.source_ip: r for r in detect_web_attacks(entries(spark, rows)).collect()}
    hot = json.loads(alerts["1.1.1.1"].evidence)
    assert hot["attempt_count"] == 200 and hot["sample_lines"] == list(range(1, 11))
    assert hot["sample_endpoints"] == ["/.env?0", "/.env?1", "/.env?2"] and alerts["1.1.1.1"].severity == "medium"
    assert json.loads(alerts["unknown"].evidence)["sample_endpoints"] == ["x" * 100]


def test_exfiltration_error_flood_and_names(spark):
    rows = [{"source_ip": "1.1.1.1", "endpoint": f"/{i % 7}", "response_size": 2**20 * (i % 7 + 1)} for i in range(70)]
    rows += [{"source_ip": "2.2.2.2", "status_code": 404}] * 50 + [{"source_ip": "2.2.2.2", "status_code": 500}]
    rows += [{"source_ip": "3.3.3.3", "username": u, "event_type": "sudo_command"} for u in ("root", "Root", "bob")]
    alerts = {r.detector: r for r in all_alerts(entries(spark, rows)).collect()}
    assert set(alerts) == {"exfiltration", "error_flood", "multi_privileged"}
    evidence = json.loads(alerts["exfiltration"].evidence)
    assert evidence["total_mb"] == 280.0 and alerts["exfiltration"].severity == "high"
    assert [e["endpoint"] for e in evidence["top_endpoints"]] == ["/6", "/5", "/4", "/3", "/2"]
    flood = json.loads(alerts["error_flood"].evidence)
    assert flood == {"4xx_count": 50, "5xx_count": 1, "status_distribution": {"404": 50, "500": 1}, "total_errors": 51}
    assert alerts["multi_privileged"].target_account == "Root, root"


def test_order_is_by_severity_then_detector(spark):
    rows = [{"endpoint": "/.env"}, {"username": "root", "event_type": "login_success", "second": 0}]
    assert [r.detector for r in run_all(entries(spark, rows)).collect()] == ["off_hours_login", "web_attacks"]
    assert set(DETECTOR_FUNCTIONS) >= {"brute_force", "rate_abuse"}
    assert Counter(r.severity for r in run_all(entries(spark, rows), detectors=["web_attacks"]).collect()) == {"low": 1}


def test_alerts_print_the_logged_clock(spark, as_lines):
    line = '203.0.113.7 - - [09/Feb/2026:{} {}] "POST /session HTTP/1.1" 401 10 "-" "x"'
    logged = [(f"01:59:{i:02d}", "+0200") for i in range(50, 60)] + [("18:30:05", "-0530")]
    found = normalize_access(as_lines("\n".join(line.format(*at) for at in logged))).cache()
    burst = json.loads(detect_brute_force(found).first().evidence)
    assert (burst["first_attempt"], burst["last_attempt"]) == ("2026-02-09 01:59:50+02:00", "2026-02-09 01:59:59+02:00")
    rate = run_all(found, {"rate_abuse": {"threshold": 10}}, detectors=["rate_abuse"]).first()
    assert "Peak window: 2026-02-09 01:59:50+02:00 to 2026-02-09 01:59:59+02:00." in rate.description


def test_entries_are_read_three_times_at_most(spark, tmp_path, monkeypatch):
    """All detectors share three passes over the entries; bursts of refused logins alone take two."""
    place = str(tmp_path / "marked-entries")
    spark.createDataFrame([], ENTRY_SCHEMA).write.parquet(place)
    entries, scans = spark.read.schema(ENTRY_SCHEMA).parquet(place), []

    def scans_in(frame):
        leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
        found = [leaves.apply(i) for i in range(leaves.size())]
        files = [leaf for leaf in found if leaf.getClass().getSimpleName() == "LogicalRelation"]
        return sum("marked-entries" in leaf.relation().location().rootPaths().mkString() for leaf in files)

    def counting(frame, name):
        scans.append(scans_in(frame))
        return stored(frame, name)

    for module in (detect, detect_abuse, brute_force_detector, detect_login):
        monkeypatch.setattr(module, "stored", counting)
    scans.append(scans_in(detect.all_alerts(entries)))
    assert sum(scans) == 3
    scans.clear()
    scans.append(scans_in(detect_brute_force(entries)))
    assert sum(scans) == 2
