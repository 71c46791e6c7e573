"""Counting quotient filters against dictionaries, and collocations against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from wardlog.llm import collocations as co
from wardlog.llm import joins
from wardlog.llm import quotient_filter as cqf
from wardlog.llm.collocations import collocations

from .conftest import EDGE_ROWS

ASCII = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def random_ids(rng, words, n, most):
    return [rng.integers(1, most, n, dtype=np.uint32) for _ in range(words)]


@pytest.mark.parametrize("words", [2, 3, 4, 5])
@pytest.mark.parametrize("most", [4, 2**32 - 1])
def test_permutation_and_filters_lose_nothing(words, most):
    rng = np.random.default_rng(words)
    for n in (1, 2, 5, 3000):
        ids = random_ids(rng, words, n, most)
        head, rest = cqf.permuted(ids)
        for given, back in zip(ids, cqf.word_ids(head, rest, words)):
            assert (given == back).all()
        want = Counter(zip(*(column.tolist() for column in ids)))
        # filters of two shards, cut by ranges, encoded, decoded and merged
        bits, found = 3, Counter()
        shards = [cqf.counted(head[:n // 2], [r[:n // 2] for r in rest]), cqf.counted(head[n // 2:], [r[n // 2:] for r in rest])]
        for prefix in range(1 << bits):
            parts = []
            for h, r, c in shards:
                inside = (h >> np.uint64(64 - bits)).astype(int) == prefix
                if inside.any():
                    data = cqf.encode(h[inside], [x[inside] for x in r], c[inside], words, bits)
                    parts.append(cqf.decode(data, prefix))
            if parts:
                h, r, c = cqf.merged(parts)
                assert (np.diff(h.astype(object)) >= 0).all()
                found.update(dict(zip(zip(*(x.tolist() for x in cqf.word_ids(h, r, words))), c.tolist())))
        assert found == want


def test_counters_of_any_size():
    counts = np.array([1, 127, 128, 16_383, 16_384, 2**40 + 5, 2**62, 3], np.int64)
    assert (cqf.counts_of(cqf.counter_planes(counts), len(counts)) == counts).all()
    ids = [np.arange(1, 9, dtype=np.uint32)] * 2
    head, rest = cqf.permuted(ids)
    order = np.argsort(head)
    h, _, c = cqf.decode(cqf.encode(head[order], rest, counts, 2), 0)
    assert (h == head[order]).all() and (c == counts).all()


def plain(rows, least, top=2000, percent=100):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(ASCII)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        inside = defaultdict(int)
        for g, a in found.items():
            for i in range(len(g)):
                for j in range(i + 2, len(g) + 1):
                    if j - i < len(g):
                        inside[g[i:j]] = max(inside[g[i:j]], a)
        listed = []
        for g, a in found.items():
            if 100 * inside[g] >= percent * a:
                continue
            score, k = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
            listed.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(listed)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def some_rows():
    rng = random.Random(8)
    fixed = ["new york city", "in The end", "a b a b a b", "é x", "中文 词 语", "as well as", "to be or not to be", "x\ty"]
    rows = []
    for i in range(160):
        parts = []
        for _ in range(rng.randrange(30)):
            parts.append(rng.choice(fixed) if rng.random() < 0.5 else f"w{int(rng.paretovariate(0.6))}")
            parts.append(rng.choice([" ", "  ", "\t", ", ", ".", "\n", " ", " ", "\x0b"]))
        rows.append(("".join(parts), rng.choice(["en", "en", "en", "de", None, "und", "中"])))
    # unicode spaces and a mark inside a word do not part words
    return rows + [("a\xa0b   c\x00d a\xa0b   c\x00d " * 6, "en"), (None, "en"), ("", None), (" . ", "xx")]


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


def frame_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(rows)], FIELDS)


SIZES = {
    "as registered": {}, "small steps": {"TEXT_STEP": 7, "STEP": 16, "HELD": 32, "ID_BUCKETS": 3},
    "full bitmap": {"MAP_BITS": 3, "RANGE_WORDS": 1}, "joined ids": {"DICTIONARY_WORDS": 0},
}


@pytest.mark.parametrize("sizes", SIZES)
def test_collocations(spark, monkeypatch, sizes):
    for name, value in SIZES[sizes].items():
        monkeypatch.setattr(co, name, value)
    rows = some_rows()
    want = plain(rows, 4)
    assert len(want) > 40 and {len(w[2].split(" ")) for w in want} >= {2, 3, 4, 5}
    assert rows_of(collocations(frame_of(spark, rows), 4)) == want


def test_top_percent_and_salted_joins(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(co, "DICTIONARY_WORDS", 0)
    rows = some_rows()
    assert rows_of(collocations(frame_of(spark, rows), 3, 7, 60)) == plain(rows, 3, 7, 60)


def test_large_products_are_exact(spark):
    big = 10**15 + 37
    phrases = spark.createDataFrame([([1, 2], big, 3 * big, "p")], "ids array<long>, a long, n long, phrase string")
    parts = spark.createDataFrame([([1], big + 5), ([2], 7)], "part array<long>, f long")
    row = co.scored(phrases, parts).first()
    assert row["score"] == 1000 * big * 3 * big // ((big + 5) * 7)


def test_edges(spark, as_docs):
    rows = [(text, "en") for _, text in EDGE_ROWS]
    want = plain(rows, 2)
    assert want and rows_of(collocations(as_docs(EDGE_ROWS), 2)) == want
    assert rows_of(collocations(as_docs(EDGE_ROWS, clashing=True), 2)) == want
    assert rows_of(collocations(as_docs([]), 2)) == []
    assert rows_of(collocations(as_docs(EDGE_ROWS), 10**6)) == []
