"""Fill-in-middle against plain Python, and exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlog.llm import fill_in_middle as fim
from wardlog.llm.fill_in_middle import fill_in_middle, op13_columns, restored
from wardlog.llm.wavelet import CLASSES, WaveletMatrix

from .conftest import EDGE_ROWS

UNIT = {"lines": r"[^\n]*\n|[^\n]+", "sentences": r"[^\n.!?]*[\n.!?]|[^\n.!?]+",
        "words": r"[^\n\t\r \x0b\x0c]*[\n\t\r \x0b\x0c]|[^\n\t\r \x0b\x0c]+"}


def plain(doc_id, text, units="lines", percent=100):
    text = text or ""
    parts = re.findall(UNIT[units], text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    low, high = sorted(x % (len(parts) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(parts), "plain", None, None, text
    p, m, s = ("".join(x) for x in (parts[:low], parts[low:high], parts[high:]))
    if h[3] % 100 < 50:
        return len(parts), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(parts), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_ranks_and_places():
    rng = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 700):
        data = rng.choice(np.frombuffer("aZ9 \n.,é😀".encode(), np.uint8), size)
        matrix, classes = WaveletMatrix(data), CLASSES[data]
        places = np.arange(size + 1)
        for kind in range(8):
            ranks = np.concatenate([[0], np.cumsum(classes == kind)])
            assert (matrix.rank(kind, places) == ranks).all()
            found = matrix.after((kind,), places, np.zeros_like(places), np.full_like(places, size))
            for n, place in zip(places, found):
                assert place == next((k for k in range(size + 1) if ranks[k] >= n), size)


def some_rows():
    rng = random.Random(5)
    pieces = ["a line\n", "\n", "é 😀. ", "no end", "x! y? ", "\r\n", "<", "P>", "<S", "中文。\n", "word "]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))) for i in range(150)]
    marks = [(200, "a <P> b\nc"), (201, "x<S>\n"), (202, "<M>"), (203, "<p>\nb"), (204, "<\nP>\n<S")]
    return rows + marks + EDGE_ROWS


@pytest.mark.parametrize("units", list(UNIT))
@pytest.mark.parametrize("step", [16, 1 << 20])
def test_cuts_and_forms(spark, as_docs, units, step, monkeypatch):
    monkeypatch.setattr(fim, "STEP_BYTES", step)
    rows = some_rows()
    for percent in (100, 40):
        out = fill_in_middle(as_docs(rows), units, percent).withColumn("back", restored(F.col("form"), F.col("output")))
        got = sorted(out.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output").collect(), key=repr)
        want = [(i, text, *plain(i, text, units, percent)) for i, text in rows]
        assert list(map(tuple, got)) == sorted(want, key=repr)
        assert out.where("back <> coalesce(text, '') or back is null").count() == 0
    assert {"plain", "spm", "psm"} == {w[3] for w in want}


def test_digests_and_other_columns(spark, as_docs):
    docs = as_docs(some_rows(), clashing=True).selectExpr("*", "'x' as form", "1 as n", "2 as `_fim_n`", "3 as `a.b`")
    out = fill_in_middle(docs)
    assert set(out.columns) == {*docs.columns, "prefix_chars", "middle_chars", "output"}
    assert out.where("`a.b` = 3 and _fim_n = 2 and form <> 'x'").count() == docs.count()
    got = sorted(map(tuple, op13_columns(out).collect()), key=repr)
    want = []
    for i, text in some_rows():
        n, form, p, m, output = plain(i, text)
        want.append((i, n, form, p, m, *(hashlib.sha256(t.encode()).hexdigest() for t in (output, text or ""))))
    assert got == sorted(want, key=repr)
    assert fill_in_middle(as_docs([])).count() == 0
