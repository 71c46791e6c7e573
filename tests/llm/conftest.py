import random

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
# columns an operator might make itself
CLASHES = ["score", "spans", "row", "words", "key", "region", "node", "shard", "slot", "block", "bin", "severity",
           "_id", "text_key", "window", "start", "n_words", "component_id", "part", "ids", "toxic", "kept"]


@pytest.fixture
def as_docs(spark):
    """A documents table of (doc_id, text) or (doc_id, text, lang) rows; clashing adds columns of awkward names."""

    def make(rows, clashing=False):
        rows = [(*row, "en")[:3] for row in rows]
        frame = spark.createDataFrame(
            [(i, text, lang, "src", len(text or "")) for i, text, lang in rows], DOCUMENT
        )
        if clashing:
            frame = frame.selectExpr("*", *[f"'clash' as `{name}`" for name in CLASHES])
        return frame

    return make


def some_words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


EDGE_ROWS = [
    (1, None), (2, ""), (3, " \t\n "), (None, "a text without an id but with words in it"), (4, "one"), (5, "tie tie tie"),
    (6, "tie tie tie"), (7, "repeated row of some words here"), (7, "repeated row of some words here"),
    (8, " ".join(some_words(random.Random(3), 30_000))), (9, "\u00c9t\u00e9 \u4e2d\u6587 \U0001f600 caf\u00e9!!"), (None, None), (10, "..."),
]
