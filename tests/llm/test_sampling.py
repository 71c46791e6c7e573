"""Weighted samples against a plain version, and their collision rate against generalised Jaccard similarity."""

import hashlib
import math
import random
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from wardlog.llm import weighted_sampling as ws
from wardlog.llm.weighted_sampling import fingerprints

from .conftest import EDGE_ROWS, some_words

ASCII = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def weights(text):
    return Counter(w for w in re.split("[\x20\x09-\x0d]+", text.translate(ASCII)) if w)


def jaccard(a, b):
    words = set(a) | set(b)
    total = sum(max(a[w], b[w]) for w in words)
    return sum(min(a[w], b[w]) for w in words) / total if total else 1.0


def hashed(term, number):
    return xxhash.xxh64_intdigest(struct.pack("<i", number), xxhash.xxh64_intdigest(struct.pack("<Q", term), 42))


def part(bits, shift, width):
    return ((bits >> shift & (1 << width) - 1) + 0.5) / (1 << width)


def samples(text):
    """The drawn word and step of each sample."""
    drawn = []
    counted = [(w, xxhash.xxh64_intdigest(w.encode(), 42) >> 24, n) for w, n in weights(text).items()]
    for k in range(ws.SAMPLES if counted else 0):
        block, place = divmod(k, ws.BLOCK)
        best = None
        for word, term, n in counted:
            bits = hashed(term, block * 64 + 32 + place // ws.SHARED)
            r, b = -math.log(part(bits, 0, 21) * part(bits, 21, 21)), part(bits, 42, 22)
            t = math.floor(math.log(n) / r + b)
            bits = hashed(term, block * 64 + place)
            c = -math.log(part(bits, 0, 32) * part(bits, 32, 32))
            best = min(best or (math.inf,), (c * math.exp(-r * (t - b + 1)), word, t))
        drawn.append(best[1:])
    return drawn


def likeness(a, b):
    if not a or not b:
        return float(a == b)
    return sum(x == y for x, y in zip(a, b)) / ws.SAMPLES


def plain(rows):
    """Rows ordered by id and text, each with its follower."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    known, out = {}, []

    def of(text):
        return known.setdefault(text, samples(text))

    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((i, len(text), digest, likeness(of(text), of(edited)), likeness(of(text), of(after))))
    return sorted(out, key=repr)


def some_rows(rng, n, ids):
    texts = [" ".join(some_words(rng, rng.randrange(60), 30)) for _ in range(n // 2)]
    return [(i, rng.choice(texts) + rng.choice(["", " More", "\n\té😀 x"])) for i in rng.sample(ids, n)]


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "near_edited", "near_next"]


@pytest.mark.parametrize("slice_rows, ids", [
    (1, range(300)), (7, range(0, 10**15, 10**10 + 7)), (10**6, range(-50, 400)), (1, [*range(100), *range(10**9, 10**9 + 50)]),
])
def test_plain_version(spark, as_docs, monkeypatch, slice_rows, ids):
    monkeypatch.setattr(ws, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(ws, "EDGES", 16)
    rows = some_rows(random.Random(slice_rows), 120, ids)
    got = fingerprints(as_docs(rows))
    assert sorted(map(tuple, got.select(COLUMNS).collect()), key=repr) == plain(rows)


@pytest.mark.parametrize("clashing", [False, True])
def test_edge_rows(spark, as_docs, monkeypatch, clashing):
    monkeypatch.setattr(ws, "SLICE_ROWS", 2)
    got = fingerprints(as_docs(EDGE_ROWS, clashing))
    assert sorted(map(tuple, got.select(COLUMNS).collect()), key=repr) == plain(EDGE_ROWS)
    assert got.where("fingerprint is null or (fingerprint = '') <> (doc_id in (1, 2, 3) or doc_id is null and n_chars = 0)").count() == 0
    assert got.where("length(fingerprint) not in (0, 8 * 64)").count() == 0
    one = fingerprints(as_docs([(5, "just one text here")])).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 18
    assert fingerprints(as_docs([])).count() == 0


def test_equal_texts_have_equal_fingerprints(spark, as_docs):
    rng = random.Random(9)
    texts = [" ".join(some_words(rng, 40)) for _ in range(20)]
    rows = [(i, texts[i % 20]) for i in range(100)] + [(200 + i, " ".join(reversed(t.upper().split()))) for i, t in enumerate(texts)]
    got = fingerprints(as_docs(rows)).select("fingerprint", F.when(F.col("doc_id") < 200, F.col("doc_id") % 20).otherwise(F.col("doc_id") - 200).alias("t"))
    assert got.distinct().count() == 20


def test_collisions_estimate_generalised_jaccard(spark, as_docs):
    """Texts of very uneven weights, each pair with words of its own, as a word's draws are the same in all texts: the
    mean error is near zero and the spread that of independent draws."""
    rng = random.Random(4)
    rows = []
    for i in range(0, 600, 2):
        words = [f"w{i}x{int(rng.paretovariate(0.7))}" for _ in range(150)]
        kept = rng.randrange(150)
        others = [f"v{i}x{int(rng.paretovariate(0.7))}" for _ in range(150 - kept)]
        rows += [(i, " ".join(words)), (i + 1, " ".join(words[:kept] + others))]
    got = {r["doc_id"]: r["near_next"] for r in fingerprints(as_docs(rows)).collect()}
    errors = [got[i] - jaccard(weights(rows[i][1]), weights(rows[i + 1][1])) for i in range(0, 600, 2)]
    mean = sum(errors) / len(errors)
    spread = math.sqrt(sum(e * e for e in errors) / len(errors))
    assert abs(mean) < 0.012 and spread < 0.09  # r and b are shared by four draws
