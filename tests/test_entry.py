"""The registered queries on the smallest test tables, where those are present."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as contract
from wardlog.operators.detect import DETECTOR_FUNCTIONS
from wardlog.plans import fixtures as fx
from wardlog.plans.catalogue import QUERIES
from wardlog.plans.oracles import ORACLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
# these run jobs while they are built
EAGER = {
    "read_waf_files", "read_text_files", "listed_files", "stored_entries", "stored_alerts", "ingested_stream",
    "streamed_rate", "analyzed_files", "ingested_alerts",
}


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(contract.queries()) >= set(QUERIES) and set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_runs(spark):
    rows = contract.entry(spark).collect()
    assert rows and {"source_ip", "success_after_failures"} <= set(rows[0].asDict())


def test_plans_have_no_cross_join_and_no_single_task(spark, monkeypatch):
    """One task for all rows is only right for a total, or behind a limit. The alerts are made once for all plans."""
    alerts = fx.alert_fixture(spark, FOLDER)
    monkeypatch.setattr(fx, "alert_fixture", lambda spark, folder: alerts)
    totals = {"search_count", "alert_total", "job_total"}
    wrong = []
    for name, run in QUERIES.items():
        if name in EAGER:
            continue
        plan = run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        if re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan):
            wrong.append((name, "cross join"))
        if "SinglePartition" in plan and name not in totals:
            wrong.append((name, "single task"))
        if re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups", plan):
            wrong.append((name, "Python"))
    assert not wrong


def test_alert_queries_meet_every_detector(spark):
    alerts = fx.alert_fixture(spark, FOLDER.replace("0.001", "0.01"))
    assert {r.detector for r in alerts.select("detector").distinct().collect()} == set(DETECTOR_FUNCTIONS)
    assert alerts.select("created_at").distinct().count() > 1
