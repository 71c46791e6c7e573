"""Times of many forms, years of logs without one, records valid at an event, merged counts and deep pages."""

import json
import random
import warnings
from datetime import datetime, timedelta

import pytest
from dateutil import parser as dateutil_parser
from pyspark.sql import functions as F

from wardlog.operators import dashboard as dash
from wardlog.operators import rollups, search, years
from wardlog.operators.normalize import normalize_auth, normalize_json
from wardlog.operators.reputation import records_at
from wardlog.operators.years import with_years
from wardlog.schema import ENTRY_SCHEMA

LINES = "job_id string, source_file string, line_number long, raw_line string"
FORMS = [
    "%Y-%m-%d %I:%M %p", "%d %B %Y %H:%M:%S", "%B %d %Y", "%b-%d-%Y", "%Y %b %d", "%d %b, %Y at %H:%M", "%A %d %B %Y %I:%M:%S %p",
    "%a %b %d %H:%M:%S %Y", "%a %b %d %H:%M:%S EST %Y", "%m/%d/%Y", "%m/%d/%y", "%m-%d-%Y %H:%M", "%Y/%m/%d", "%Y.%m.%d", "%d.%m.%Y",
    "%Y%m%d", "%Y%m%d%H%M", "%Y%m%d%H%M%S", "%Y%m%dT%H%M%S", "%Y%m%d %H%M%S", "%y%m%d", "%b %d, %Y %I%p", "%I:%M%p %b %d %Y", "%H:%M:%S %d-%b-%Y",
    "%d-%b-%y", "%y-%b-%d", "%Y-%m-%dT%H:%M:%S.%f", "%b %dth, %Y", "%dth of %B %Y %H:%M:%S.%f", "%d/%m/%Y %H:%M", "%S", "%Y", "%H:%M", "word %Y-%m-%d",
    "%Y-%m-%d 25:00", "%Y-13-%d", "13/%d/%Y", "%m.%d.%Y %I:%M:%S %p", "%Y, %B %d",
]


def expected(text):
    """What the parser makes of the text, if it finds a whole date there: nothing is taken from the day it is asked."""
    found = []
    for default in (datetime(2001, 1, 1), datetime(2004, 2, 2)):
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                found.append(dateutil_parser.parse(text, default=default).replace(tzinfo=None))
        except (ValueError, OverflowError):
            return None
    return found[0] if found[0] == found[1] else None


def test_times_of_many_forms(spark):
    rng, texts = random.Random(2), []
    for _ in range(30):
        at = datetime(rng.randrange(1981, 2060), rng.randrange(1, 13), rng.randrange(1, 29)) + timedelta(
            seconds=rng.randrange(86400), microseconds=rng.randrange(10**6)
        )
        texts += [at.strftime(form) for form in FORMS]
    rows = [("j", "f", i, json.dumps({"time": t})) for i, t in enumerate(texts)]
    got = {r.line_number: r.event_time_local for r in normalize_json(spark.createDataFrame(rows, LINES)).collect()}
    wrong = [(t, got[i], expected(t)) for i, t in enumerate(texts) if got[i] != expected(t)]
    assert not wrong, wrong[:10]
    assert sum(v is not None for v in got.values()) > 0.75 * len(texts)


@pytest.mark.parametrize("slot, bound", [(4096, 200_000), (7, 200_000), (7, 0)])
def test_years_follow_the_order_of_lines(spark, monkeypatch, slot, bound):
    monkeypatch.setattr(years, "SLOT_LINES", slot)
    monkeypatch.setattr(years, "BROADCAST_SLOTS", bound)
    rng, rows, want = random.Random(6), [], {}
    for file, start in (("a", datetime(2022, 11, 20)), ("b", datetime(2024, 2, 27)), ("c", datetime(2025, 5, 1))):
        at, moments = start, []
        for _ in range(150):
            at += timedelta(hours=rng.choice([1, 30, 24 * 9]))
            moments.append(at)
        for k in range(0, 149, 5):  # late lines, also over the turns of months and years
            if moments[k + 1] - moments[k] < timedelta(days=2):
                moments[k], moments[k + 1] = moments[k + 1], moments[k]
        for n, at in enumerate(moments, 1):
            text = f"{at:%b} {at.day} {at:%H:%M:%S} host sshd[1]: Failed password for root from 1.2.3.4 port 22 ssh2"
            rows.append((file, file, n, text if n % 11 else "no header here"))
            if n % 11:
                want[(file, n)] = at
    lines = spark.createDataFrame(rows, LINES)
    first = F.when(F.col("source_file") == "a", 2022).when(F.col("source_file") == "b", 2024).otherwise(2025)
    entries = normalize_auth(with_years(lines, first), assume_year=F.col("log_year"))
    got = {(r.job_id, r.line_number): r.event_time_local for r in entries.collect() if r.event_time_local}
    assert got == want and {at.year for at in want.values()} >= {2022, 2023, 2024, 2025}


def test_records_at_the_time_of_the_event(spark):
    rng, base = random.Random(7), datetime(2026, 1, 1)
    moment = lambda: base + timedelta(seconds=rng.randrange(-50_000, 50_000))
    events = [(i, rng.choice(["1.1.1.1", "2.2.2.2", "2001:db8::1", None]), moment() if i % 17 else None, "clash") for i in range(400)]
    records = [(rng.choice(["1.1.1.1", "2.2.2.2", "2001:0DB8::1", "9.9.9.9", None]), moment(), n) for n in range(60)]
    records += [(events[1][1], events[1][2], 1000), ("1.1.1.1", None, 5)]
    got = records_at(
        spark.createDataFrame(events, "id int, source_ip string, event_time timestamp, slice string"),
        spark.createDataFrame(records, "ip string, checked_at timestamp, score int"), ttl_seconds=3600,
    ).select("id", "slice", "record.score").collect()
    same = lambda ip: ip and ip.lower().replace("0db8", "db8")
    for r in got:
        _, ip, at, _ = events[r.id]
        valid = [(c, s) for i, c, s in records if at and ip and c and same(i) == ip and timedelta(0) <= at - c <= timedelta(hours=1)]
        assert r.slice == "clash" and r.score == (max(valid)[1] if valid else None)
    assert len(got) == 400 and sum(r.score is not None for r in got) > 50


def entries_of(spark, n):
    rng = random.Random(n)
    rows = []
    for i in range(n):
        at = datetime(2026, 1, 1) + timedelta(minutes=37 * i)
        rows.append((f"job{rng.randrange(3)}", i // 2, at, at if i % 9 else None, f"10.0.{rng.randrange(9)}.{rng.randrange(200)}", None,
                     rng.choice(["a", "b", None]), rng.choice(["/x", "/y", None]), "GET", rng.choice([200, 404, None]), 5, None,
                     rng.choice(["login_failed", "login_success", "waf_block", "waf_allow", "access"]), f"GET {i % 7}", "",
                     {"terminating_rule": rng.choice(["r1", "r2", ""])}))
    return spark.createDataFrame(rows, ENTRY_SCHEMA)


def test_dashboard_of_rollups(spark, tmp_path):
    """Three batches, one written twice, give the dashboard of all entries, which are not read."""
    entries, folder = entries_of(spark, 900), str(tmp_path / "rollups")
    alerts = spark.createDataFrame([("job0", "high", "web_attack")], "job_id string, severity string, alert_type string")
    for batch in (0, 1, 2, 1):
        rollups.write_rollup(entries.filter(F.col("line_number") % 3 == batch), folder, batch)
    found = rollups.dashboard_of_rollups(spark, folder, alerts)
    order = lambda frame: sorted(map(str, frame.collect()))
    assert order(found) == order(dash.dashboard(entries, alerts))
    exact = dict(entries.groupBy("job_id").agg(F.count_distinct("source_ip")).collect())
    estimated = dict(rollups.estimated_addresses(spark, folder).collect())
    assert exact.keys() == estimated.keys() and all(abs(estimated[j] - n) <= 0.05 * n for j, n in exact.items())


@pytest.mark.parametrize("ranges", [3, 1000])
def test_pages_at_any_depth(spark, monkeypatch, ranges):
    monkeypatch.setattr(search, "RANGES", ranges)
    entries = entries_of(spark, 240).persist()
    for conditions in ({}, {"event_type": "waf_block", "search": "get"}):
        order = lambda e: (e.line_number, e.job_id)
        keys = sorted(map(order, search.matching_entries(entries, **conditions).collect()))
        for page in (1, 3, 24):
            found = search.search_entries(entries, page, 10, deep_rows=15, **conditions)
            assert list(map(order, found.collect())) == keys[10 * page - 10:10 * page]
    assert search.search_entries(entries.limit(0), 9, 10, deep_rows=15).count() == 0
