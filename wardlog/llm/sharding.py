"""Uniform sharding with exact shard sizes.

Rows lie in blocks, chosen by hash. A hypergeometric communication matrix says how many rows each block
sends to each shard: row sums are the block sizes, column sums the shard sizes, and the draw is that of a
uniform shuffle of all rows. Each block is permuted and cut by its matrix row, the rows are exchanged, and
each shard is permuted again. Every order comes from hashes of the row and a seed, so a task that is run
again after a lost executor deals its rows out as before.
"""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlog.llm.tables import shared_path
from wardlog.llm.text import text_or_empty

SHARDS = 8
BLOCK_ROWS = 100_000
LEAST_BLOCKS = 64
SLOT_RANGES = 16
ALL = 1 << 62


def hypergeometric(rng, good, bad, drawn):
    """Good ones among `drawn` of good + bad, exact in law at any size.

    Inversion around the mode: the ratios of neighbouring probabilities give the law over the values
    within 40 standard deviations; what lies beyond has less than 1e-300 of it.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    spread = 60 + int(40 * (drawn * (good / total) * (bad / total)) ** 0.5)
    first, last = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log((good - k) * (drawn - k)) - np.log((k + 1) * (bad - drawn + k + 1))
    law = np.concatenate([[0.0], np.cumsum(steps)])
    law = np.exp(law - law.max())
    return first + int(np.searchsorted(np.cumsum(law) / law.sum(), rng.random(), side="right"))


def communication_matrix(block_sizes, shard_sizes, seed):
    """Rows sent from each block to each shard; block_sizes is in block order."""
    rng = np.random.default_rng(seed)
    room, matrix = list(shard_sizes), []
    for size in block_sizes:
        left, free, row = size, sum(room), []
        for shard, places in enumerate(room):
            sent = hypergeometric(rng, places, free - places, left) if left else 0
            row.append(sent)
            left, free = left - sent, free - places
            room[shard] -= sent
        matrix.append(row)
    return matrix


def row_key(seed, salt):
    """A hash order; equal rows may swap, which changes nothing."""
    return F.xxhash64(F.lit(seed), F.lit(salt), F.col("doc_id"), F.col("text_crc32"), F.col("size"))


def shard_rows(docs, shards=SHARDS, seed=7, block_rows=BLOCK_ROWS):
    """One row per document row: size, text_crc32, shard (0 to shards - 1) and slot (gapless from 0).

    Shard counts differ by one at most. docs has doc_id and text; other columns are ignored. A null text
    has size 1 and checksum 0, a null doc_id is dealt like any other. Rows that repeat are rows of their
    own. An empty table gives no rows. The driver sees one count per block and the matrix: shards numbers
    for each block_rows rows.
    """
    spark = docs.sparkSession
    data = F.encode(text_or_empty(), "utf-8")
    rows = docs.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    # narrow rows, written once: the counts and the deal below see the same rows
    path = shared_path(spark, "shard-rows")
    rows.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema("doc_id long, size long, text_crc32 long").parquet(path)
    total = rows.count()
    if not total:
        return rows.selectExpr("*", "0 as shard", "0L as slot")
    blocks = max(LEAST_BLOCKS, -(-total // block_rows))
    rows = rows.withColumn("block", F.pmod(row_key(seed, 0), F.lit(blocks)).cast("int"))
    counted = {row["block"]: row["count"] for row in rows.groupBy("block").count().collect()}
    sizes = [counted.get(block, 0) for block in range(blocks)]
    shard_sizes = [total // shards + (shard < total % shards) for shard in range(shards)]
    matrix = communication_matrix(sizes, shard_sizes, seed)

    # local permutation: a block's rows in hash order, cut where the matrix says
    bounds = ",".join(" ".join(map(str, np.cumsum(row))) for row in matrix)
    cuts = F.split(F.element_at(F.split(F.lit(bounds), ","), F.col("block") + 1), " ").cast("array<long>")
    order = row_key(seed, 1)
    place = F.row_number().over(Window.partitionBy("block").orderBy(order, "doc_id", "size"))
    dealt = (
        rows.withColumn("place", place)
        .withColumn("cuts", cuts)
        .withColumn("shard", F.size(F.filter("cuts", lambda cut: cut < F.col("place"))))
        .drop("cuts", "place", "block")
    )
    # final permutation: the hash order of a shard, numbered by ranges so that no task holds a whole shard
    ranges = max(SLOT_RANGES, -(-total // (shards * block_rows)))
    mixed = dealt.withColumn("order", F.shiftrightunsigned(row_key(seed, 2), 2)).withColumn(
        "part", F.floor(F.col("order") / F.lit(ALL / ranges)).cast("int")
    )
    part = Window.partitionBy("shard", "part")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        mixed.groupBy("shard", "part").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0)))
    )
    return (
        mixed.withColumn("within", F.row_number().over(part.orderBy("order", "doc_id", "size", "text_crc32")))
        .join(F.broadcast(starts.select("shard", "part", "start")), ["shard", "part"])  # shards x ranges rows
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("within") - 1).alias("slot"))
    )


def op4_columns(rows):
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs, path, shards=SHARDS, seed=7):
    """Writes the documents to path/shard=N, each shard in slot order within its files; returns the plan.

    The plan is written first and joined by row, so the files agree with it; rows of one id and text take the plan's
    rows of their key in the order of their other columns, so that a task that runs again deals them alike.
    """
    plan = shard_rows(docs, shards, seed)
    key = ["doc_id", "text_crc32"]
    number = F.row_number().over(Window.partitionBy(*key).orderBy("shard", "slot"))
    told = plan.select(*[F.col(k).alias(f"_{k}") for k in key], "shard", "slot", number.alias("_n"))
    crc = F.crc32(F.encode(text_or_empty(), "utf-8"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), "doc_id",
                        crc.alias("text_crc32"))
    whole = whole.withColumn("_m", F.row_number().over(Window.partitionBy(*key).orderBy(F.to_json("document"))))
    on = whole["doc_id"].eqNullSafe(told["_doc_id"]) & (F.col("text_crc32") == F.col("_text_crc32")) & (
        F.col("_m") == F.col("_n"))
    whole.join(told, on).select("document", "shard", "slot").repartition("shard", F.floor(F.col("slot") / BLOCK_ROWS)) \
        .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return plan
