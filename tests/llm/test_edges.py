"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import public_tokenizers
import pytest

from wardlog.llm.decontaminate import decontaminate, without_contaminated
from wardlog.llm.language import identify
from wardlog.llm.licenses import license_scan
from wardlog.llm.ngram_join import ngram_join
from wardlog.llm.packing import pack
from wardlog.llm.quality_rules import quality_rules
from wardlog.llm.secrets import redact, secret_scan
from wardlog.llm.sharding import shard_rows
from wardlog.llm.toxicity import toxicity, without_toxic
from wardlog.llm.warc import round_trip

from .conftest import EDGE_ROWS

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def labels(spark):
    return spark.createDataFrame(
        [(4, 1, 0), (5, 1, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int"
    )


def items(spark):
    return spark.createDataFrame([(1, "tie tie"), (2, None), (None, "some words"), (3, "")], "item_id long, text string")


OPERATORS = {
    "join": lambda spark, docs: ngram_join(docs),
    "secrets": lambda spark, docs: secret_scan(docs),
    "redact": lambda spark, docs: redact(docs).select("doc_id", "text"),
    "decontaminate": lambda spark, docs: decontaminate(docs, items(spark)),
    "shard": lambda spark, docs: shard_rows(docs),
    "license": lambda spark, docs: license_scan(docs),
    "toxicity": lambda spark, docs: toxicity(docs, labels(spark)),
    "quality": lambda spark, docs: quality_rules(docs, labels(spark).where("quality = 1")),
    "language": lambda spark, docs: identify(docs),
}


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row_whatever_the_columns(spark, as_docs, name):
    operator = OPERATORS[name]
    plain = rows_of(operator(spark, as_docs(EDGE_ROWS)))
    assert len(plain) == len(EDGE_ROWS)
    assert rows_of(operator(spark, as_docs(EDGE_ROWS, clashing=True))) == plain


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, as_docs, name):
    assert OPERATORS[name](spark, as_docs([])).count() == 0


def test_empty_side_tables(spark, as_docs):
    docs = as_docs(EDGE_ROWS)
    none = labels(spark).limit(0)
    assert toxicity(docs, none).where("toxic").count() == 0
    assert quality_rules(docs, none).where("score <> 0").count() == 0
    assert decontaminate(docs, items(spark).limit(0)).where("contaminated").count() == 0


def test_filters_keep_columns(spark, as_docs):
    docs = as_docs(EDGE_ROWS, clashing=True)
    assert without_toxic(docs, labels(spark)).columns == docs.columns
    capitals = as_docs([(1, "A Tie TIE, more"), (2, "clean Text")])
    assert [r["doc_id"] for r in without_contaminated(capitals, items(spark)).collect()] == [2]
    kept = without_contaminated(docs, items(spark))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 8, 9, 10]
    assert redact(docs).columns == docs.columns


def test_packing_and_archives(spark, as_docs):
    docs = as_docs(EDGE_ROWS, clashing=True)
    pieces = pack(docs, TOKENIZER).collect()
    assert sum(p["start"] == 0 for p in pieces) == len(EDGE_ROWS)
    assert pack(as_docs([]), TOKENIZER).count() == 0
    pages = docs.selectExpr("doc_id page_id", "source url", "text html", "'x' payload", "'x' record_type", "'x' at")
    assert round_trip(pages).count() == len(EDGE_ROWS)
    assert round_trip(pages.limit(0)).count() == 0
