"""Classifiers and quality rules: planted cases, held-out accuracy, and plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import xxhash

from wardlog.llm import language
from wardlog.llm import quality_rules as rules
from wardlog.llm.language import codewords, identify
from wardlog.llm.toxicity import fit, severities, toxicity, without_toxic

from .conftest import some_words


def test_toxic_documents_are_found(spark, as_docs):
    rng = random.Random(1)
    bad, stem = ["idiot", "scum", "moron"], "vequ"
    rows, labels = [], []
    for i in range(400):
        words, toxic = some_words(rng, rng.randrange(20, 200)), i % 7 == 0
        for _ in range(rng.randrange(3, 7) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(bad) if i % 2 else stem + rng.choice("abcdefgh") * 2
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(toxic)))
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity(as_docs(rows), frame).collect()}
    missed = [i for i in got if i % 7 == 0 and not got[i]["toxic"]]
    assert len(missed) <= 2 and not [i for i in got if i % 7 and got[i]["toxic"]]
    assert all(0 <= r["severity"] <= 3 and 0 <= r["grade"] <= 3 for r in got.values())
    kept = sorted(r["doc_id"] for r in without_toxic(as_docs(rows), frame).collect())
    assert kept == sorted(missed + [i for i in range(400) if i % 7])


def test_ordered_thresholds():
    rows = [(i, int(k > 0), tuple(range(k))) for i, k in enumerate([0, 0, 0, 1, 2, 3, 4, 5, 6] * 20)]
    weights, cuts = fit(rows, 6)
    assert (np.diff(cuts) > 0).all()
    expected, _ = severities(np.array([weights[:k].sum() for k in range(7)]), cuts)
    assert (np.diff(expected) > 0).all() and expected[0] < 0.5 < expected[1]


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text):
    words = WORD.findall(text or "")
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update((i, i + 1, i + 2))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(covered), failed)


def signed_bucket(*words):
    seed = 42
    for word in words:
        seed = xxhash.xxh64_intdigest(word.encode(), seed)
    return (seed - (1 << 64) if seed >> 63 else seed) % rules.BUCKETS


def grams(text):
    words = WORD.findall(text or "")
    return [signed_bucket(w) for w in words] + [signed_bucket(*pair) for pair in zip(words, words[1:])]


def test_quality_rules(spark, as_docs):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        words = some_words(rng, rng.choice([0, 1, 2, 49, 50, 90, 200]), rng.choice([3, 20, 3000]))
        if i % 4 == 0:
            words = [w + "***" for w in words]
        rows.append((i, "".join(w + rng.choice([" ", "\n", "\n\n", "\x0b", "  "]) for w in words)))
    trusted = [i for i in range(120) if i % 4 and i % 3]
    frame = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    got = sorted(rules.quality_rules(as_docs(rows), frame).collect(), key=lambda r: r["doc_id"])
    raw, target = Counter(), Counter()
    for i, text in rows:
        raw.update(grams(text))
        target.update(grams(text) if i in trusted else [])
    n_raw, n_target = sum(raw.values()) + rules.BUCKETS, sum(target.values()) + rules.BUCKETS
    for row, (i, text) in zip(got, rows):
        want = statistics(text)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert tuple(row[n] for n in names) == want
        ratios = [math.log((target[g] + 1) / n_target) - math.log((raw[g] + 1) / n_raw) for g in grams(text)]
        score = sum(ratios) / len(ratios) if ratios else 0.0
        assert abs(row["score"] - score) < 1e-9
        assert row["kept"] == (not want[-1] and row["score"] >= rules.THRESHOLD)


def test_codewords_tell_languages_apart():
    for n in (1, 2, 4, 7, 12, 40):
        code = codewords(list(range(n)))
        assert len({tuple(row) for row in code}) == n


def test_languages(spark, as_docs):
    rng = random.Random(3)
    syllables = {"en": "th er on ing wh at", "de": "sch ung ch keit ei für", "fr": "eau oi que é è ment", "xx": "ка ло ми ра"}
    rows = []
    for i in range(600):
        lang = rng.choice(list(syllables))
        words = ["".join(rng.choices(syllables[lang].split(), k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60))]
        rows.append((i, " ".join(words).upper() if i % 9 == 0 else " ".join(words), lang))
    rows += [(700, "123 !!", "en"), (701, None, "en"), (702, "", "en")]
    got = identify(as_docs(rows)).collect()
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert len(held) > 100 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert {r["lang_pred"] for r in got if r["doc_id"] >= 700} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got)


def test_every_language_is_learned(spark, as_docs, monkeypatch):
    """More languages than a task holds or the driver spreads out at a time; the rarest are told apart as well."""
    rng = random.Random(4)
    monkeypatch.setattr(language, "BLOCK_LANGUAGES", 7)
    rows = []
    for k in range(90):
        syllables = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(5)]
        for _ in range(40 if k < 64 else 16):
            words = ["".join(rng.choices(syllables, k=rng.randrange(1, 3))) for _ in range(30)]
            rows.append((len(rows), " ".join(words), f"l{k:02}"))
    rng.shuffle(rows)
    truth = {i: lang for i, _, lang in rows}
    for most in (1_000_000, 0):
        monkeypatch.setattr(language, "BROADCAST_IDS", most)
        got = identify(as_docs(rows)).collect()
        assert {r["lang_pred"] for r in got} == set(truth.values())
        held = [r for r in got if r["held_out"]]
        assert len(held) > 500 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_counts_are_handed_on_in_parts(spark, as_docs, monkeypatch):
    rows = [(i, f"some words of {i % 9} and {i}", f"l{i % 9}") for i in range(200)]
    dense = lambda: {k: language.spread(v).tolist() for k, v in language.training_counts(as_docs(rows), 1_000).items()}
    whole = dense()
    monkeypatch.setattr(language, "HELD_LANGUAGES", 2)
    assert len(whole) == 9 and dense() == whole


def test_codewords_of_many_languages(monkeypatch):
    code = codewords(range(300))
    assert len({tuple(row) for row in code}) == 300
    monkeypatch.setattr(language, "STEP_ROWS", 7)
    assert (codewords(range(300)) == code).all()
