"""Every choice by size: the way for large tables gives the rows of the way for small ones, and those of brute force."""

import pytest

import corpus_pipeline
from wardlog.llm import decontaminate as decontamination
from wardlog.llm import joins, language, ngram_join, secrets
from wardlog.llm import quality_rules as rules
from wardlog.llm.decontaminate import decontaminate, without_contaminated
from wardlog.llm.language import identify
from wardlog.llm.quality_rules import quality_rules
from wardlog.llm.secrets import redact, secret_scan
from wardlog.llm.warc import round_trip

from .conftest import EDGE_ROWS
from .test_join import brute_force, copies
from .test_pipeline import ITEMS, assert_packed, corpus, is_foul, kept_rows, redacted, saved
from .test_scans import decontaminated

BOUNDS = [
    (joins, "BROADCAST_ROWS"), (ngram_join, "BROADCAST_IDS"), (secrets, "BROADCAST_ROWS"), (rules, "BROADCAST_IDS"),
    (decontamination, "BROADCAST_DOCUMENTS"), (decontamination, "BROADCAST_WINDOWS"), (language, "BROADCAST_IDS"),
]


@pytest.fixture
def all_large(monkeypatch):
    for module, name in BOUNDS:
        assert getattr(module, name) > 0
        monkeypatch.setattr(module, name, 0)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_join(spark, as_docs, all_large):
    rows = copies(11, 60)
    assert rows_of(ngram_join.ngram_join(as_docs(rows), region_rows=4)) == sorted(brute_force(rows, 4, 85), key=repr)


def test_archives(spark, all_large):
    pages = [(i, f"http://h/{i}", html) for i, html in enumerate(["a", "b", "a", None, "", "a", "WARC/1.1\r\nx", "b"])]
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in round_trip(
        spark.createDataFrame(pages, "page_id long, url string, html string")
    ).collect()}
    assert got == {0: ("response", None), 1: ("response", None), 2: ("revisit", 0), 3: ("response", None), 4: ("revisit", 3),
                   5: ("revisit", 0), 6: ("response", None), 7: ("revisit", 1)}


def test_scans(spark, as_docs, monkeypatch):
    rows = [(i, t) for i, t in corpus()[0] if i is not None and i >= 400] + EDGE_ROWS
    rows = list({i: (i, t) for i, t in rows if i is not None}.values())
    docs, items = as_docs(rows), spark.createDataFrame(ITEMS, "item_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in rows[::2]], "doc_id long, quality int")
    operators = [
        lambda: decontaminate(docs, items), lambda: without_contaminated(docs, items), lambda: secret_scan(docs),
        lambda: redact(docs), lambda: quality_rules(docs, labels), lambda: identify(docs),
    ]
    small = [rows_of(operator()) for operator in operators]
    assert small[0] == sorted(decontaminated(rows, ITEMS), key=repr)
    for module, name in BOUNDS:
        monkeypatch.setattr(module, name, 0)
    assert [rows_of(operator()) for operator in operators] == small


def test_pipeline(spark, tmp_path, all_large):
    rows, labels = corpus()
    folder = saved(spark, tmp_path, rows, labels)
    want = kept_rows([r for r in rows if not is_foul(r[1])])
    want = [(i, redacted(t)) for i, t in want if not decontaminated([(i, t)], ITEMS)[0][-1]]
    assert_packed(corpus_pipeline.run(spark, folder).collect(), want)
