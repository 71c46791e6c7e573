"""A training corpus from the documents table: five stages, each written as Parquet and read again."""

import public_tokenizers
from pyspark.sql import functions as F

from wardlog.llm.decontaminate import without_contaminated
from wardlog.llm.ngram_join import without_near_duplicates
from wardlog.llm.packing import pack
from wardlog.llm.secrets import redact
from wardlog.llm.tables import stored, table
from wardlog.llm.toxicity import without_toxic

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def reject_toxic(spark, docs, sf_dir):
    """Documents below the severity limit stay."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of linked texts stays, the one with the smallest doc_id."""
    return without_near_duplicates(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that hold a window of a benchmark item go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def redact_secrets(spark, docs, sf_dir):
    """Secrets are replaced by a mark; every document stays."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark, docs, sf_dir):
    """Pieces of documents and their places in sequences."""
    return pack(docs, TOKENIZER)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("packing", pack_sequences),
]

# the models and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds each stage and run() against plain Python
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
