"""Quality rules: text statistics, and a hashed n-gram log-likelihood ratio against trusted texts.

Words and pairs of adjacent words are hashed into buckets. Two multinomials are counted over all
documents: one of the trusted texts, one of the whole corpus. A document's score is the mean over its
n-grams of log(p_trusted / p_corpus); documents below a fixed threshold are rejected.
"""

import math

from pyspark.sql import functions as F

from wardlog.llm.text import blank_words, text_or_empty

BUCKETS = 16384
THRESHOLD = -0.05
BROADCAST_IDS = 1_000_000


def three_word_windows(words):
    return F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )


def with_repeated_words(rows):
    """n_repeat_words from windows, an array of hashes in text order.

    Windows are sorted with their places; equal neighbours repeat. Each place covers three words, but
    only up to the next repeated place. Each step is a column of its own, as an expression inside a
    lambda would be evaluated for every element. Texts without a repeated window skip it all.
    """
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = F.filter(
        "placed",
        lambda x, i: (x["h"] == F.get("placed", i - 1)["h"]) | (x["h"] == F.get("placed", i + 1)["h"]),
    )
    covered = F.aggregate(
        F.transform("places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("places", i + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    return (
        rows.withColumn("placed", F.when(repeats, placed))
        .withColumn("places", F.when(F.col("placed").isNotNull(), F.sort_array(F.transform(same, lambda x: x["i"]))))
        .withColumn("n_repeat_words", F.when(F.col("places").isNull(), F.lit(0).cast("long")).otherwise(covered))
        .drop("windows", "placed", "places")
    )


def text_statistics(docs):
    """doc_id, words and the counts of the rules, one row per document row."""
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = (
        docs.select("doc_id", text_or_empty().alias("text"))
        .select(
            "doc_id",
            blank_words("text").alias("words"),
            F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            lines.alias("lines"),
        )
        .select(
            "doc_id",
            "words",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            "n_symbols",
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            three_word_windows(F.col("words")).alias("windows"),
        )
    )
    return with_repeated_words(rows)


def bucket(*parts):
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def bucket_of_pair(pair):
    """Null for the last word, which has no neighbour."""
    return F.when(F.col(f"{pair}.b").isNotNull(), bucket(f"{pair}.a", f"{pair}.b"))


def with_last(words):
    """(a, b) for each word and the one behind it, null behind the last."""
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, F.size(words)).alias("b"))


def log_ratios(docs, trusted):
    """log(p_trusted / p_corpus) by bucket, with one added to each count.

    The counts cover every document. Only BUCKETS totals reach the driver. Trusted ids are broadcast
    up to BROADCAST_IDS rows and joined by a shuffle beyond.
    """
    ids = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("trusted", F.lit(1))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    counted = (
        docs.select("doc_id", text_or_empty().alias("text"))
        .join(ids, "doc_id", "left")
        .select(blank_words("text").alias("words"), "trusted")
        .where(F.size("words") > 0)
        .select(F.explode(with_last(F.col("words"))).alias("pair"), "trusted")
        .select(F.explode(F.array(bucket("pair.a"), bucket_of_pair("pair"))).alias("bucket"), "trusted")
        .where("bucket is not null")
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
        .collect()
    )
    raw, target = [1] * BUCKETS, [1] * BUCKETS
    for row in counted:
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["target"]
    total_raw, total_target = sum(raw), sum(target)
    if total_target == BUCKETS:
        return [0.0] * BUCKETS
    return [math.log(t / total_target) - math.log(r / total_raw) for t, r in zip(target, raw)]


def mean_ratio(pairs, ratios):
    """Mean log ratio over a text's words and word pairs; 0 without words."""
    weights = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    total = F.aggregate(
        pairs,
        F.lit(0.0),
        lambda s, p: s
        + F.get(weights, bucket(p["a"]))
        + F.when(p["b"].isNotNull(), F.get(weights, bucket(p["a"], p["b"]))).otherwise(0.0),
    )
    return F.when(F.size(pairs) > 0, total / (2 * F.size(pairs) - 1)).otherwise(0.0)


def quality_rules(docs, trusted, threshold=THRESHOLD):
    """One row per document row: statistics, score and verdict.

    docs has doc_id and text, trusted the doc_id of trusted texts; other columns are ignored. A null
    text is empty: no words, base_failed. Rows that repeat are judged alike. Without any trusted text all
    scores are 0 and only the base rules reject. Empty tables give no rows.
    """
    ratios = log_ratios(docs, trusted)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        text_statistics(docs)
        .withColumn("pairs", with_last(F.col("words")))
        .withColumn("score", mean_ratio(F.col("pairs"), ratios))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
        .drop("words", "pairs")
    )
