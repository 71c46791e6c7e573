"""Phrase collocations, counted in counting quotient filters.

Words that are frequent enough for a phrase get ids, texts become runs of ids, and phrases of two to five words are
counted level by level. Each task counts into filters of its own, which are cut by ranges of quotients and merged
range by range. A phrase of n words is only counted if both its parts of n-1 words may be frequent; that is read from a
bitmap of fixed size over the quotients of the frequent parts, which lets a few too many through and never one too few.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlog.llm.arrow import map_batches
from wardlog.llm import quotient_filter as cqf
from wardlog.llm.joins import lookup
from wardlog.llm.tables import stored
from wardlog.llm.text import ascii_lower

LEAST_COUNT = 100
MOST_WORDS = cqf.MAX_WORDS
TOP = 2000
INSIDE_PERCENT = 100
UNKNOWN = "und"
# what ends a piece, and what else parts words
ENDS = ".,;:!?\n\x0b\x0c\r"
GAPS = r"[.,;:!?\x09-\x0D\x20]+"
DICTIONARY_WORDS = 500_000  # words that every worker holds; texts are joined with more
ID_BUCKETS = 1024
TEXT_STEP = 1 << 18  # bytes of text turned to ids at a time
STEP = 1 << 17  # ids, and windows over them, looked at together
HELD = 1 << 19  # entries of a task's filter
RANGE_WORDS = 1 << 19  # words of the corpus for each range of quotients
MIN_RANGE_BITS, MAX_RANGE_BITS = 7, 20
MAP_BITS = 26
SALTS = 16

# A-Z in lower case, every end of a piece a full stop, which no word can hold
CLEAN = bytes(
    ord(".") if chr(b) in ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256)
)


def word_counts(docs, text, lang):
    """lang, word, f of every word; a null lang is und."""
    words = F.explode(F.split(ascii_lower(F.col(text)), GAPS))
    rows = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), words.alias("word"))
    return rows.where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("f"))


def with_ids(words):
    """Dense ids from 1, in an order that follows from the words alone: numbered within buckets of a hash, the buckets
    one behind the other."""
    bucketed = words.withColumn("_bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(ID_BUCKETS)))
    sizes = dict(bucketed.groupBy("_bucket").count().collect())
    offsets, total = [], 0
    for bucket in range(ID_BUCKETS):
        offsets.append(total)
        total += sizes.get(bucket, 0)
    if total >= 1 << 32:
        raise ValueError(f"{total} words do not fit into ids of 32 bits")
    order = Window.partitionBy("_bucket").orderBy("lang", "word")
    offset = F.element_at(F.lit(offsets).cast("array<bigint>"), F.col("_bucket").cast("int") + 1)
    return bucketed.withColumn("id", F.row_number().over(order) + offset).drop("_bucket"), total


def token_steps(text):
    """The words of a text as bytes, a full stop behind each piece, some megabytes at a time."""
    data = text.encode().translate(CLEAN)
    start = 0
    while start < len(data):
        end = start + TEXT_STEP
        if end < len(data):
            # a word is not cut: on to the next gap
            gaps = [g for g in (data.find(b" ", end), data.find(b".", end), data.find(b"\t", end)) if g >= 0]
            end = min(gaps, default=len(data))
        yield data[start:end].replace(b".", b" . ").split()
        start = end


def encoded(docs, dictionary, text, lang):
    """Rows of ids: little-endian 32-bit word ids of texts, with 0 for other words and between pieces."""
    spark = docs.sparkSession
    known = {}
    for row in dictionary.select("lang", "word", "id").toLocalIterator():
        known.setdefault(row["lang"], {})[row["word"].encode()] = row["id"]
    shared = spark.sparkContext.broadcast(known)
    rows = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))

    def encode(batches):
        parts, size = [], 0
        for batch in batches:
            for language, value in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                ids = shared.value.get(language, {}).get
                for tokens in token_steps(value or ""):
                    parts.append(np.fromiter((ids(token, 0) for token in tokens), "<u4", len(tokens)))
                    size += len(tokens)
                parts.append(np.zeros(1, "<u4"))
                if size >= STEP:
                    yield pa.RecordBatch.from_pydict({"ids": pa.array([np.concatenate(parts).tobytes()], pa.binary())})
                    parts, size = [], 0
        if size:
            yield pa.RecordBatch.from_pydict({"ids": pa.array([np.concatenate(parts).tobytes()], pa.binary())})

    return rows.transform(map_batches, encode, "ids binary")


def encoded_by_join(docs, dictionary, text, lang):
    """As `encoded`, for dictionaries of any size: words are joined with their ids and put in order again, a document
    at a time."""
    ends = f"[{ENDS}]"
    pieces = F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), ends)
    rows = docs.select(
        F.monotonically_increasing_id().alias("_doc"), F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"),
        # an empty word stands between pieces
        F.flatten(F.transform(pieces, lambda p: F.concat(
            F.filter(F.split(p, r"[\x20\x09]+"), lambda w: w != ""), F.array(F.lit(""))
        ))).alias("words"),
    )
    # written first, so that numbers stay the same if a task runs again
    rows = stored(rows, "collocation-words").select("_doc", "lang", F.posexplode("words").alias("_place", "word"))
    ids = lookup(rows, dictionary.select("lang", "word", "id"), ["lang", "word"], "_doc")
    listed = ids.groupBy("_doc").agg(F.sort_array(F.collect_list(F.struct("_place", "id"))).alias("_ids"))
    listed = listed.select(F.transform("_ids", lambda x: F.coalesce(x["id"], F.lit(0)).cast("long")).alias("_ids"))

    def pack(batches):
        for batch in batches:
            column = [np.append(np.asarray(row, "<u4"), np.uint32(0)).astype("<u4").tobytes()
                      for row in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"ids": pa.array(column, pa.binary())})

    return listed.transform(map_batches, pack, "ids binary")


def in_bitmap(bitmap, head):
    places = (head >> np.uint64(64 - MAP_BITS)).astype(np.int64)
    return bitmap[places >> 3] >> (places & 7).astype(np.uint8) & 1 > 0


def windows(ids, words, bitmap):
    """The packed n-grams of a stretch of ids whose words all have an id and whose parts may be frequent."""
    n = len(ids) - words + 1
    if n <= 0:
        return None
    whole = np.ones(n, bool)
    for k in range(words):
        whole &= ids[k:k + n] > 0
    starts = np.flatnonzero(whole)
    if bitmap is not None and len(starts):
        part, _ = cqf.permuted([ids[starts + k] for k in range(words - 1)])
        starts = starts[in_bitmap(bitmap, part)]
        part, _ = cqf.permuted([ids[starts + k + 1] for k in range(words - 1)])
        starts = starts[in_bitmap(bitmap, part)]
    return cqf.permuted([ids[starts + k] for k in range(words)]) if len(starts) else None


def count_level(texts, words, range_bits, bitmap, least, name):
    """id list and f of the phrases of this many words that occur `least` times: w1..wn, f, and slot, the place in the
    bitmap."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(bitmap) if bitmap is not None else None

    def blocks(table):
        """The filter cut by ranges of quotients."""
        head, rest, counts = table
        ranges = (head >> np.uint64(64 - range_bits)).astype(np.int64)
        edges = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])[:len(head)])
        ends = np.append(edges[1:], len(head))
        data = [cqf.encode(head[a:b], [r[a:b] for r in rest], counts[a:b], words, range_bits) for a, b in zip(edges, ends)]
        return pa.RecordBatch.from_pydict({"range": pa.array(ranges[edges], pa.int64()), "filter": pa.array(data, pa.binary())})

    def count(batches):
        held, waiting, size = [], [], 0
        for batch in batches:
            for value in batch.column(0):
                ids = np.frombuffer(value.as_buffer(), "<u4")
                for start in range(0, len(ids), STEP):
                    found = windows(ids[start:start + STEP + words - 1], words, shared and shared.value)
                    if found is None:
                        continue
                    waiting.append(cqf.counted(*found))
                    size += len(waiting[-1][0])
                    if size >= HELD:
                        held, waiting, size = cqf.merged([*held, *waiting]), [], 0
                        if len(held[0]) >= HELD:
                            yield blocks(held)
                            held = []
                        else:
                            held = [held]
        if held or waiting:
            yield blocks(cqf.merged([*held, *waiting]))

    names = [f"w{k}" for k in range(1, words + 1)]

    def merge(key, table):
        prefix = key[0].as_py()
        parts = [cqf.decode(value.as_py(), prefix) for value in table.column("filter")]
        head, rest, counts = cqf.merged(parts)
        often = counts >= least
        head, rest, counts = head[often], [part[often] for part in rest], counts[often]
        columns = dict(zip(names, (c.astype(np.int64) for c in cqf.word_ids(head, rest, words))))
        return pa.table(columns | {"f": counts, "slot": (head >> np.uint64(64 - MAP_BITS)).astype(np.int64)})

    schema = ", ".join(f"{name} long" for name in [*names, "f", "slot"])
    filters = texts.transform(map_batches, count, "range long, filter binary")
    return stored(filters.groupBy("range").applyInArrow(merge, schema), name)


def bitmap_of(level):
    """The occupied slots of a level as bits. The driver gets 2**MAP_BITS bits at most, whatever the number of phrases."""
    one_more = F.col("slot") + 1  # Spark's buckets begin at 1
    chunks = level.groupBy(F.bitmap_bucket_number(one_more).alias("chunk")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(one_more)).alias("bits")
    )
    bitmap = np.zeros(max((1 << MAP_BITS) // 8, 4096), np.uint8)
    for row in chunks.toLocalIterator():
        bits = np.frombuffer(row["bits"], np.uint8)
        start = (row["chunk"] - 1) * 4096
        bitmap[start:start + len(bits)] = bits
    return bitmap


def scored(phrases, parts):
    """phrases (ids, a, n) with l, r and score of their lowest-scoring cut; parts are (part, f) of all words and phrases.

    Numbers of up to 18 digits are multiplied as decimals of 38 digits, so that the quotient is exact.
    """
    wide = "decimal(18,0)"
    cuts = phrases.withColumn("k", F.explode(F.expr("sequence(1, size(ids) - 1)")))
    cuts = lookup(cuts.withColumn("part", F.expr("slice(ids, 1, k)")), parts, "part", "ids")
    cuts = cuts.withColumn("l", F.col("f")).drop("f", "part")
    cuts = lookup(cuts.withColumn("part", F.expr("slice(ids, k + 1, size(ids))")), parts, "part", "ids")
    cuts = cuts.withColumn("r", F.col("f")).drop("f", "part")
    product = f"cast(a as {wide}) * cast(n as {wide}) * 1000"
    cuts = cuts.withColumn("score", F.expr(f"({product}) div (cast(l as {wide}) * cast(r as {wide}))"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    kept = [c for c in phrases.columns if c != "ids"]
    return cuts.groupBy("ids").agg(*[F.first(c).alias(c) for c in kept], lowest).select(
        "ids", *kept, "cut.l", "cut.r", "cut.score"
    )


def not_inside(phrases, inside_percent):
    """Phrases without those inside a longer one that is as frequent, in per cent.

    What holds for any longer phrase holds for the one a word longer too, as that is at least as frequent.
    """
    longer = phrases.where("size(ids) > 2")
    inner = longer.select(
        F.explode(F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids))"))).alias("ids"), "a"
    )
    most = inner.groupBy("ids").agg(F.max("a").alias("most"))
    return phrases.join(most, "ids", "left").where(
        F.col("most").isNull() | (100 * F.col("most") < inside_percent * F.col("a"))
    ).drop("most")


def spelled(phrases, dictionary):
    """phrases with lang and phrase, their words joined with a space."""
    words = phrases.select("ids", F.posexplode("ids").alias("place", "id"))
    words = lookup(words, dictionary.select("id", "lang", "word"), "id", "ids")
    texts = words.groupBy("ids").agg(
        F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("place", "word"))).alias("_w")
    )
    return phrases.join(texts.select("ids", "lang", F.array_join("_w.word", " ").alias("phrase")), "ids")


def collocations(docs, least=LEAST_COUNT, top=TOP, inside_percent=INSIDE_PERCENT, text="text", lang="lang"):
    """The first `top` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    Words are parted by blanks and tabs, in ASCII lower case, within pieces parted by .,;:!? and line ends. n counts the
    words of a language, a the places of the phrase, l and r those of its two parts, for the cut with the lowest
    floor(1000 a n / (l r)) (the first of equal ones). Phrases of 2 to 5 words at `least` places or more are candidates;
    one that stands inside a longer candidate at least inside_percent per cent as frequent is dropped. Ties of the score
    go by a, then by the phrase's bytes. Null texts are empty, a null language is und, repeated rows count again, and
    an empty table, or one without frequent phrases, gives no rows.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    words = stored(word_counts(rows, "text", "lang"), "collocation-counts")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    dictionary, size = with_ids(words.where(F.col("f") >= least))
    dictionary = stored(dictionary, "collocation-ids")
    encode = encoded if size <= DICTIONARY_WORDS else encoded_by_join
    texts = stored(encode(rows, dictionary, "text", "lang"), "collocation-texts")
    total = words.agg(F.sum("f")).first()[0] or 0
    range_bits = min(max((total // RANGE_WORDS).bit_length(), MIN_RANGE_BITS), MAX_RANGE_BITS)
    parts = dictionary.select(F.array("id").alias("part"), "f")
    phrases, bitmap = None, None
    for n in range(2, MOST_WORDS + 1):
        level = count_level(texts, n, range_bits, bitmap, least, f"collocation-{n}")
        found = level.select(F.array(*[f"w{k}" for k in range(1, n + 1)]).alias("ids"), F.col("f").alias("a"))
        phrases = found if phrases is None else phrases.unionByName(found)
        if n < MOST_WORDS:
            bitmap = bitmap_of(level)
    parts = parts.unionByName(phrases.select(F.col("ids").alias("part"), F.col("a").alias("f")))
    kept = spelled(not_inside(phrases, inside_percent), dictionary)
    kept = scored(lookup(kept, totals, "lang", "ids"), parts)
    best = [F.desc("score"), F.desc("a"), "phrase"]
    # ranked in shares first, so that no task gets more than a bounded number of rows of a language
    share = Window.partitionBy("lang", "_share").orderBy(*best)
    kept = kept.withColumn("_share", F.pmod(F.hash("phrase"), F.lit(SALTS)))
    kept = kept.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)))
    return kept.where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
