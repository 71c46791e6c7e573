"""The corpus pipeline: each stage, and all of them in turn, against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from wardlog.llm.ngram_join import without_near_duplicates

from .conftest import DOCUMENT, EDGE_ROWS, some_words
from .test_join import shingles
from .test_scans import base_spans, decontaminated

FOUL = [f"foul{k}" for k in range(12)]
ITEMS = [(1, " ".join(f"q{k}" for k in range(14))), (2, "short item of five words"), (3, None), (4, "")]


def rng_text(rng, n, extra=()):
    words = some_words(rng, n, 3000)
    for word in extra:
        words.insert(rng.randrange(len(words) + 1), word)
    return " ".join(words)


def corpus():
    """(doc_id, text) rows and the labels of some: toxic, copied, near-copied, contaminated, secret-bearing rows, and
    rows of repeated and missing ids."""
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(120):
        foul = i % 4 == 0
        rows.append((i, rng_text(rng, 60, rng.sample(FOUL, 5) if foul else ())))
        if i < 80:
            labels.append((i, 1, int(foul)))
    clean = [r for r in rows if r[0] % 4]
    rows += [(200 + k, t) for k, (_, t) in enumerate(clean[:10])]  # copies
    for k, (_, t) in enumerate(clean[10:20]):  # near copies: a word less at the end
        rows.append((300 + k, t.rsplit(" ", 1)[0]))
    rows += [(400 + k, f"{rng_text(rng, 20)} {ITEMS[0][1].upper()} {rng_text(rng, 9)}") for k in range(5)]
    rows += [(410, "Short item, of FIVE words!"), (411, "short item of five")]
    rows += [(500 + k, f'{rng_text(rng, 15)} password="hunter{k}hunter{k}" {rng_text(rng, 15)} {"0123456789abcdef" * 2}') for k in range(4)]
    a, b, c, d, e = (rng_text(rng, 30) for _ in range(5))
    rows += [(601, a), (602, b), (602, c), (603, b), (604, d), (604, a), (None, e), (None, e), (None, c), (None, "an id-less text")]
    return rows + [(700 + (i or 0) if i else None, t) for i, t in EDGE_ROWS], labels


def is_foul(text):
    return bool(set((text or "").split()) & set(FOUL))


def kept_rows(rows, width=5, percent=80):
    """Of each group of linked texts the row of the smallest id."""
    sets = [shingles(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""), width) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_gram = defaultdict(list)
    for k, grams in enumerate(sets):
        for g in grams:
            by_gram[g].append(k)
    near = {(a, b) for listed in by_gram.values() for a in listed for b in listed if a < b}
    for a, b in near:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k) if sets[k] else -1 - k].append(rows[k])
    # rows of one id in one group may be any of them
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def redacted(text):
    if text is None:
        return None
    spans = sorted((int(s.split(":")[1]), int(s.split(":")[2])) for s in base_spans(text))
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def assert_packed(pieces, rows, window=2048):
    tokenizer = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    ids = [(i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")) for i, t in rows]
    want = Counter((i, len(x)) for i, x in ids)
    assert Counter((p["doc_id"], p["doc_tokens"]) for p in pieces if p["start"] == 0) == want
    checks = Counter((i, s, len(x[s:s + window]), zlib.crc32(x[s:s + window].tobytes())) for i, x in ids for s in range(0, len(x), window))
    assert Counter((p["doc_id"], p["start"], p["length"], p["ids_crc32"]) for p in pieces) == checks
    ends = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == ends[p["sequence_id"]]
        ends[p["sequence_id"]] += p["length"]
    assert max(ends.values(), default=0) <= window and len(ends) <= 1.3 * sum(ends.values()) / window + 2


def saved(spark, tmp_path, rows, labels):
    frame = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], DOCUMENT)
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def rows_of(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=repr)


def test_stages_and_run(spark, tmp_path):
    rows, labels = corpus()
    folder = saved(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    plain = [
        lambda given: [r for r in given if not is_foul(r[1])],
        kept_rows,
        lambda given: [r for r in given if not decontaminated([r], ITEMS)[0][-1]],
        lambda given: [(i, redacted(t)) for i, t in given],
    ]
    want, sizes = rows, [len(rows)]
    for (name, stage), version in zip(corpus_pipeline.STAGES, plain):
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        want = sorted(version(want), key=repr)
        assert rows_of(docs) == want, name
        docs = corpus_pipeline.stored(docs, name)
        assert docs.where("n_chars <> length(coalesce(text, ''))").count() == 0
        sizes.append(len(want))
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] and any("[secret]" in (t or "") for _, t in want)
    assert_packed(corpus_pipeline.STAGES[4][1](spark, docs, folder).collect(), want)
    assert_packed(corpus_pipeline.run(spark, folder).collect(), want)


@pytest.mark.parametrize("rows", [EDGE_ROWS, []])
def test_stages_on_edge_rows(spark, tmp_path, rows):
    folder = saved(spark, tmp_path, rows, [(4, 1, 0), (5, 1, 1), (None, 1, 1), (7, None, None)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
    want = [(i, redacted(t)) for i, t in kept_rows(rows) if not decontaminated([(i, t)], ITEMS)[0][-1]]
    assert rows_of(docs) == sorted(want, key=repr)
    assert_packed(corpus_pipeline.STAGES[4][1](spark, docs, folder).collect(), want)
    assert corpus_pipeline.STAGES[0][1](spark, docs, folder).columns == docs.columns


def test_unrelated_texts_of_one_id_stay(spark, as_docs):
    """Texts are judged, not ids; other columns come along."""
    words = ["alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven", "quite another text of some words here",
             "z y x w v u t s"]
    rows = [(1, words[0]), (2, words[1]), (2, words[2]), (3, words[1]), (4, words[3]), (4, words[0])]
    docs = as_docs(rows, clashing=True)
    kept = without_near_duplicates(docs, 5, 80)
    assert kept.columns == docs.columns
    assert rows_of(kept) == [(1, words[0]), (2, words[1]), (2, words[2]), (4, words[3])]
    nothing = [(None, "same words in both of these"), (None, "same words in both of these"), (9, "same words in both of these"), (None, ""), (None, None)]
    assert rows_of(without_near_duplicates(as_docs(nothing), 5, 80)) == sorted([nothing[2], *nothing[3:]], key=repr)
