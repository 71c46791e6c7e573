"""Joins that stay balanced when one key holds a large share of the rows."""

from pyspark.sql import functions as F

from wardlog.llm.tables import stored

SALTS = 16
BROADCAST_ROWS = 500_000


def lookup(rows, facts, key, salt_by, rows_hint=None):
    """Left join of rows with facts, which have one row per key (a column or several).

    Up to BROADCAST_ROWS facts are broadcast. Beyond, rows are dealt out by key and a salt, and each fact goes to
    every salt, so that a key with a third of all rows is shared by SALTS tasks.
    """
    count = facts.count() if rows_hint is None else rows_hint
    if count <= BROADCAST_ROWS:
        return rows.join(F.broadcast(facts), key, "left")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)))
    spread = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    keys = [key] if isinstance(key, str) else key
    return salted.join(spread, [*keys, "_salt"], "left").drop("_salt")


def components(edges, name="components"):
    """node and component (its smallest reachable node) for every node of the edges (a, b).

    Large-star and small-star steps in turn: each node's neighbours are joined to the smallest of them, until
    nothing changes. Each round is written to the shared folder; the driver sees only a count and a checksum.
    """
    links = stored(edges.where("a <> b").select("a", "b").distinct(), name)
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        links = stored(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct(),
            name,
        )
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            break
        seen = now
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
