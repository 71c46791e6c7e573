"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window is 10 neighbouring words of an item, or the whole item if it is shorter. A document can hold a
window only if it holds the window's rarest word, so that one necessary word, counted over the whole
corpus, is joined. The word's place in window and document bounds where the window can stand; the words
there are compared one by one.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlog.llm.tables import stored
from wardlog.llm.text import ascii_lower, terms, text_or_empty

WINDOW = 10
BROADCAST_WINDOWS = 200_000
BROADCAST_DOCUMENTS = 1_000_000


def word_rows(frame, *columns):
    rows = frame.select(*columns, ascii_lower(text_or_empty()).alias("text"))
    return rows.select(*rows.columns[:-1], terms("text").alias("words"))


def item_windows(benchmark, width=WINDOW):
    """item_id, words of the window; one row per place."""
    words = word_rows(benchmark, F.col("item_id").cast("string").alias("item_id")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (width - 1)))
    return words.select("item_id", "words", F.explode(starts).alias("start")).select(
        "item_id", F.slice("words", F.col("start"), F.lit(width)).alias("window")
    )


def small(frame, rows):
    """A broadcast hint if the frame is known to be small."""
    return F.broadcast(frame) if rows <= BROADCAST_WINDOWS else frame


def rarest_words(windows, documents, n_windows):
    """Distinct windows with their rarest word and its place; ties go to the first in order."""
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    counts = (
        documents.select(F.explode("words").alias("word"))
        .join(small(vocabulary, n_windows), "word", "left_semi")
        .groupBy("word")
        .count()
    )
    placed = windows.select("window").distinct().select("window", F.posexplode("window").alias("place", "word"))
    return (
        placed.join(small(counts, n_windows), "word")
        .groupBy("window")
        .agg(F.min(F.struct("count", "word", "place")).alias("first"), F.count("*").alias("found"))
        .where(F.col("found") == F.size("window"))  # a word that no document has rules the window out
        .select("window", F.col("first.word").alias("word"), F.col("first.place").alias("place"))
    )


def window_hits(documents, anchors, n_windows, width=WINDOW):
    """doc_id, text_key, window, start: each place where a document holds a window."""
    length = F.size("window")
    if n_windows <= BROADCAST_WINDOWS:
        near = (
            documents.select("doc_id", "text_key", "words", F.posexplode("words").alias("pos", "word"))
            .join(F.broadcast(anchors), "word")
            .where(F.col("pos") >= F.col("place"))
            .withColumn("start", F.col("pos") - F.col("place"))
            .where(F.col("start") + length <= F.size("words"))
            .where(F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, length) == F.col("window"))
        )
    else:  # a shuffled join; each word takes only its neighbourhood with it
        around = F.slice("words", F.greatest(F.col("pos") - (width - 2), F.lit(1)), F.lit(2 * width - 1))
        near = (
            documents.select("doc_id", "text_key", "words", F.posexplode("words").alias("pos", "word"))
            .select("doc_id", "text_key", "pos", "word", around.alias("around"))
            .join(anchors, "word")
            .withColumn("from", F.least(F.col("pos"), F.lit(width - 1)) - F.col("place"))
            .where("from >= 0")
            .where(F.slice("around", F.greatest(F.col("from"), F.lit(0)) + 1, length) == F.col("window"))
            .withColumn("start", F.col("pos") - F.col("place"))
        )
    return near.select("doc_id", "text_key", "window", "start").distinct()


def all_hits(docs, benchmark, width):
    """(documents by key, windows, their number, hits)"""
    documents = word_rows(docs, "doc_id", F.xxhash64("text").alias("text_key"))
    windows = item_windows(benchmark, width)
    n_windows = windows.count()
    anchors = rarest_words(windows, documents, n_windows)
    return documents, windows, n_windows, window_hits(documents, anchors, n_windows, width)


def without_contaminated(docs, benchmark, width=WINDOW):
    """The documents that hold no window of an item, with all their columns."""
    hits = all_hits(docs, benchmark, width)[-1]
    found = stored(hits.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "contaminated")
    found = F.broadcast(found) if found.count() <= BROADCAST_DOCUMENTS else found
    on = docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["_key"])
    return docs.join(found, on, "left_anti")


def decontaminate(docs, benchmark, width=WINDOW):
    """One row per document row: n_words, n_hit (words inside a window), the items found, and a digest.

    docs has doc_id and text, benchmark item_id and text; other columns are ignored. Null or empty texts
    have no words. Items without words make no window; an item without item_id marks words but is not
    listed. Rows that repeat get equal results. Without documents there are no rows, without items no hit.
    """
    documents, windows, n_windows, hits = all_hits(docs, benchmark, width)
    key = ["doc_id", "text_key"]

    before = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        hits.select(*key, "start", (F.col("start") + F.size("window")).alias("end"))
        .withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
        .groupBy(*key)
        .agg(
            F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reached"))).cast("long").alias("n_hit")
        )
    )
    listed = (
        hits.select(*key, "window")
        .distinct()
        .join(small(windows.distinct(), n_windows), "window")
        .groupBy(*key)
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    found = covered.join(listed, on=[covered[k].eqNullSafe(listed[k]) for k in key]).select(
        *[covered[k].alias(f"hit_{k}") for k in key], "n_hit", "items"
    )
    base = documents.select(*key, F.size("words").cast("long").alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return base.join(found, on=[base[k].eqNullSafe(F.col(f"hit_{k}")) for k in key], how="left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
