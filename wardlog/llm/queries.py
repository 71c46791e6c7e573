"""Registered queries: each applies one operator to its whole table."""

import public_tokenizers

from wardlog.llm.collocations import collocations
from wardlog.llm.decontaminate import decontaminate
from wardlog.llm.fill_in_middle import fill_in_middle, op13_columns
from wardlog.llm.language import identify
from wardlog.llm.licenses import license_scan
from wardlog.llm.ngram_join import ngram_join
from wardlog.llm.oracles import ORACLES  # noqa: F401
from wardlog.llm.packing import pack
from wardlog.llm.quality_rules import quality_rules
from wardlog.llm.secrets import secret_scan
from wardlog.llm.sharding import op4_columns, shard_rows
from wardlog.llm.tables import table
from wardlog.llm.toxicity import toxicity
from wardlog.llm.warc import round_trip
from wardlog.llm.weighted_sampling import fingerprints

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents"))


@query
def op2_secret_scans(spark, sf_dir):
    return secret_scan(table(spark, sf_dir, "documents"))


@query
def op3_decontamination(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_sharding(spark, sf_dir):
    return op4_columns(shard_rows(table(spark, sf_dir, "documents")))


@query
def op5_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), TOKENIZER)


@query
def op6_license_scans(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


@query
def op7_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_quality_rules(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return quality_rules(table(spark, sf_dir, "documents"), labels.where("quality = 1"))


@query
def op9_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


@query
def op10_warc(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "pages"))


@query
def op11_document_fingerprints(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))


@query
def op12_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


@query
def op13_fill_in_middle(spark, sf_dir):
    return op13_columns(fill_in_middle(table(spark, sf_dir, "documents")))
