"""Packing of documents into sequences of a fixed window.

Documents are cut at whole windows; what remains of each is packed. The rests' lengths form a histogram. Combinations
of up to DEPTH lengths that fill a window are its columns, and non-negative least squares says how often to
repeat each; the counts are rounded down, and what they leave is packed greedily. Rests of a length are then numbered
and dealt to the places of the plan.
"""

import zlib
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlog.llm.arrow import map_batches, texts
from wardlog.llm.tables import stored
from wardlog.llm.tokens import TextIds

WINDOW = 2048
END_ID = 1
UNIT = 8
DEPTH = 3
GROUP_ROWS = 500_000
ID_BYTES = 4


def token_rows(docs, tokenizer, window=WINDOW, keep_ids=False):
    """doc_id, doc_tokens, the checksum of each piece and, if asked for, the ids as bytes."""

    def cut(batches):
        encoder = TextIds(tokenizer)
        for batch in batches:
            count, checks, kept = [], [], []
            for ids in encoder.encode(texts(batch)):
                ids += END_ID.to_bytes(ID_BYTES, "little")
                step = window * ID_BYTES
                count.append(len(ids) // ID_BYTES)
                checks.append([zlib.crc32(ids[i:i + step]) for i in range(0, len(ids), step)])
                kept.append(ids if keep_ids else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(checks, pa.list_(pa.int64())),
                 pa.array(kept, pa.binary())],
                names=["doc_id", "doc_tokens", "checks", "ids"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").transform(
        map_batches, cut, "doc_id long, doc_tokens long, checks array<long>, ids binary"
    )


def combinations(units, bins, depth=DEPTH):
    """Up to `depth` bins that together fill the window of `units`, or all but one unit of it."""
    return [
        c for n in range(1, depth + 1) for c in combinations_with_replacement(bins, n) if units - 1 <= sum(c) <= units
    ]


def non_negative_least_squares(columns, histogram, rounds=400):
    """x >= 0 with sum_c x_c * columns_c near the histogram, by accelerated projected gradient steps.

    columns is a dense matrix (bins x combinations); both sides are bounded by the window, not by the data.
    """
    probe = np.ones(columns.shape[1])
    for _ in range(30):  # the largest eigenvalue bounds the step
        probe = columns.T @ (columns @ probe)
        norm = np.linalg.norm(probe)
        probe /= norm
    step = 0.95 / norm
    x = y = np.zeros(columns.shape[1])
    pace = 1.0
    for _ in range(rounds):
        following = np.maximum(0, y - step * (columns.T @ (columns @ y - histogram)))
        next_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        y = following + (pace - 1) / next_pace * (following - x)
        x, pace = following, next_pace
    return x


def greedy(left, units):
    """(bins, repeats) that use up the counts: the largest bin left, then the largest that still fit."""
    plan = []
    while left:
        room, taken = units, []
        counts = dict(left)
        while True:
            fits = [b for b, n in counts.items() if n and b <= room]
            if not fits:
                break
            best = max(fits)
            taken.append(best)
            counts[best] -= 1
            room -= best
        repeats = min(left[b] // taken.count(b) for b in set(taken))
        for b in taken:
            left[b] -= repeats
        left = {b: n for b, n in left.items() if n}
        plan.append((tuple(taken), repeats))
    return plan


def packing_plan(histogram, window=WINDOW, unit=UNIT, depth=DEPTH):
    """[(bins, repeats)] that places every rest; histogram counts the rests of each bin (length / unit, rounded up)."""
    units, left = window // unit, {b: n for b, n in histogram.items() if n}
    bins = sorted(left)
    plan, chosen = [], combinations(units, bins, depth)
    if chosen:
        columns = np.zeros((len(bins), len(chosen)))
        row = {b: i for i, b in enumerate(bins)}
        for j, combination in enumerate(chosen):
            for b in combination:
                columns[row[b], j] += 1
        repeats = non_negative_least_squares(columns, np.array([left[b] for b in bins], float))
        for j in np.argsort(-repeats, kind="stable"):
            taken = chosen[j]
            n = min([int(repeats[j] + 1e-6), *(left[b] // taken.count(b) for b in set(taken))])
            if n > 0:
                plan.append((taken, n))
                for b in taken:
                    left[b] -= n
    return plan + greedy({b: n for b, n in left.items() if n}, units)


def plan_places(plan):
    """(bin, low, high, first sequence, slot): rests low to high - 1 of a bin go to successive sequences. Also the
    number of sequences."""
    used, places, sequences = {}, [], 0
    for taken, repeats in plan:
        for slot, b in enumerate(taken):
            low = used.get(b, 0)
            used[b] = low + repeats
            places.append((b, low, low + repeats, sequences, slot))
        sequences += repeats
    return places, sequences


def values_frame(spark, rows, schema):
    """A small table of the driver; [] is an empty one."""
    return spark.createDataFrame(rows, schema)


def pack(docs, tokenizer, window=WINDOW, unit=UNIT, keep_ids=False):
    """One row per piece: where it stands in its document (start, length) and in its sequence (sequence_id, offset).

    docs has doc_id and text; other columns are ignored. Each document is its ids by the tokenizer file and the
    end id; a null text is empty and has the end id only. Rows that repeat are packed as documents of their own, a
    null doc_id like any other. An empty table gives no rows. With keep_ids, each piece has its ids (32-bit,
    little-endian). The driver sees the counts per length bin, and the plan over bins.
    """
    spark = docs.sparkSession
    rest = F.col("doc_tokens") % window
    rows = stored(
        token_rows(docs, tokenizer, window, keep_ids)
        .withColumn("n_full", F.floor(F.col("doc_tokens") / window))
        .withColumn("bin", F.ceil(rest / unit).cast("int"))
        .withColumn("draw", F.xxhash64("doc_id", "doc_tokens", "checks")),
        "pack-tokens",
    )
    total = rows.count()
    groups = max(8, -(-total // GROUP_ROWS))
    rows = rows.withColumn("part", F.pmod("draw", F.lit(groups)).cast("int"))
    counted = stored(
        rows.groupBy("bin", "part").agg(F.count("*").alias("n"), F.sum("n_full").alias("n_full")), "pack-counts"
    )
    # one row per bin, window / unit + 1 at most
    totals = sorted(map(tuple, counted.groupBy("bin").agg(F.sum("n"), F.sum("n_full")).collect()))
    histogram, full_before, full = {}, [], 0
    for b, n, n_full in totals:
        histogram[b] = n
        full_before.append((b, full))
        full += n_full
    histogram.pop(0, None)
    places, sequences = plan_places(packing_plan(histogram, window, unit))

    # the number of a row among the rests of its bin, and of its first whole window among all: within the group of its
    # bin and part, after the groups before
    groups_before = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.select(
        "bin", "part", F.coalesce(F.sum("n").over(groups_before), F.lit(0)).alias("rank0"),
        F.coalesce(F.sum("n_full").over(groups_before), F.lit(0)).alias("full1"),
    ).join(F.broadcast(values_frame(spark, full_before, "bin int, full0 long")), "bin")
    order = Window.partitionBy("bin", "part").orderBy("draw", "doc_id", "checks")
    numbered = (
        rows.withColumn("place", F.row_number().over(order) - 1)
        .withColumn("whole", F.sum("n_full").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_full"))
        .join(first, ["bin", "part"])
        .withColumn("rank", F.col("rank0") + F.col("place"))
        .withColumn("full", F.col("full0") + F.col("full1") + F.col("whole"))
        .drop("place", "whole", "rank0", "full0", "full1")
    )
    piece_ids = F.when(
        F.col("ids").isNotNull(),
        F.col("ids").substr((F.col("start") * ID_BYTES + 1).cast("int"), (F.col("length") * ID_BYTES).cast("int")),
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    columns += ["ids"] if keep_ids else []

    whole = (
        numbered.where("n_full > 0")
        .select("*", F.posexplode(F.slice("checks", F.lit(1), F.col("n_full").cast("int"))).alias("k", "ids_crc32"))
        .select(
            "doc_id", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"),
            "ids_crc32", "doc_tokens", (F.lit(sequences) + F.col("full") + F.col("k")).cast("long").alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"), "ids",
        )
        .withColumn("ids", piece_ids)
    )
    place = values_frame(spark, places, "bin int, low long, high long, sequence0 long, slot int")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    rests = (
        numbered.where("bin > 0")
        .join(F.broadcast(place), (numbered["bin"] == place["bin"]) & F.col("rank").between(F.col("low"), F.col("high") - 1))
        .select(
            "doc_id", (F.col("n_full") * window).alias("start"), rest.alias("length"),
            F.element_at("checks", -1).alias("ids_crc32"), "doc_tokens",
            (F.col("sequence0") + F.col("rank") - F.col("low")).alias("sequence_id"), "slot", "ids",
        )
        .withColumn("ids", piece_ids)
        .withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
        .drop("slot")
    )
    return whole.select(*columns).unionByName(rests.select(*columns))


def sequences(pieces):
    """sequence_id, length and ids of each packed sequence; pieces made with keep_ids."""
    return (
        pieces.groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"),
             F.sum("length").alias("length"))
        .select("sequence_id", "length", F.expr("aggregate(parts.ids, cast('' as binary), (a, b) -> a || b)").alias("ids"))
    )
