"""Document fingerprints by consistent weighted sampling.

A text is the set of its words, each weighted by how often it occurs. For each of SAMPLES draws every word gets, from
its hash alone, gamma-distributed r and c and a uniform b; a weight w is rounded down to a step t = floor(ln w / r + b)
of a scale that is the word's own, and the word with the least c / exp(r (t - b + 1)) is drawn. Two texts draw the same
word at the same step with a probability equal to their generalised Jaccard similarity, the sum of the smaller weights
over the sum of the larger. The least value itself stands for word and step, as no two of these share it.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlog.llm.text import ascii_lower, blank_words

SAMPLES = 64
# draws of a block are made together; r and b are shared by SHARED of them, c is not
BLOCK = 8
SHARED = 4
WEIGHT_BITS = 24
SLICES = 1 << 18
SLICE_ROWS = 48
EDGES = 1024
EDGE_GROUP = 32
ONLY_FIRST, ONLY_SECOND, BOTH = 0, 1, 2


def uniform(bits, shift, width):
    """A part of a hash as a number between 0 and 1, both excluded."""
    part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))
    return (part.cast("double") + 0.5) / float(1 << width)


def packed_terms(rows, keys, texts):
    """The words of each of the texts (columns of rows) as an array of numbers: a word's hash, and its weight in the low
    WEIGHT_BITS bits, where all larger weights count as the largest that fits.

    Each step is a projection of its own, so that arrays are made once and then read by place.
    """
    kept = [*keys, *texts]
    rows = rows.select(*keys, *[
        F.sort_array(F.transform(blank_words(ascii_lower(F.col(c))), lambda word: F.xxhash64(word))).alias(c) for c in texts
    ])

    def starts(ordered):
        """The places where a run of equal numbers begins."""
        begins = F.transform(ordered, lambda x, i: F.when((i == 0) | (ordered[i - 1] != x), i))
        return F.filter(begins, lambda i: i.isNotNull())

    rows = rows.select(*kept, *[starts(F.col(c)).alias(f"{c}_starts") for c in texts])
    rows = rows.select(
        *keys, *[F.array_distinct(c).alias(c) for c in texts],
        *[F.concat(f"{c}_starts", F.array(F.size(c))).alias(f"{c}_starts") for c in texts],
    )

    def packed(terms, places):
        def one(term, i):
            weight = F.least(places[i + 1] - places[i], F.lit((1 << WEIGHT_BITS) - 1)).cast("long")
            return F.shiftleft(F.shiftrightunsigned(term, WEIGHT_BITS), WEIGHT_BITS).bitwiseOR(weight)

        return F.transform(terms, one)

    return rows.select(*keys, *[packed(F.col(c), F.col(f"{c}_starts")).alias(c) for c in texts])


def weighted_terms(rows, keys, first, second):
    """A row per word of two texts: keys, term, weight, side. A word of equal weight in both stands once, as BOTH; a row
    without a word has one, with nulls."""
    rows = packed_terms(rows, keys, [first, second])
    a, b = F.col(first), F.col(second)
    rows = rows.select(
        *keys, F.array_except(a, b).alias("_a"), F.array_except(b, a).alias("_b"), F.array_intersect(a, b).alias("_c")
    )
    sides = [F.array_repeat(F.lit(side), F.size(c)) for c, side in (("_a", ONLY_FIRST), ("_b", ONLY_SECOND), ("_c", BOTH))]
    listed = F.arrays_zip(F.concat("_a", "_b", "_c").alias("packed"), F.concat(*sides).alias("side"))
    # inlined, as fields taken from exploded structs would be computed once per field
    rows = rows.select(*keys, F.inline_outer(listed).alias("packed", "side"))
    weight = F.col("packed").bitwiseAND(F.lit((1 << WEIGHT_BITS) - 1))
    return rows.select(*keys, F.shiftrightunsigned("packed", WEIGHT_BITS).alias("term"), weight.alias("weight"), "side")


def least_values(terms, keys):
    """For each of keys, side and block, the least value of each draw of the block."""
    blocks = F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // BLOCK - 1)))
    rows = terms.select(*keys, "term", F.log(F.col("weight").cast("double")).alias("ln_w"), "side", blocks.alias("block"))
    hashed = rows.select(
        "*", *[F.xxhash64("term", F.col("block") * 64 + 32 + g).alias(f"h{g}") for g in range(BLOCK // SHARED)]
    )
    scaled = hashed.select(
        *keys, "term", "ln_w", "side", "block",
        *[(-F.log(uniform(F.col(f"h{g}"), 0, 21) * uniform(F.col(f"h{g}"), 21, 21))).alias(f"r{g}")
          for g in range(BLOCK // SHARED)],
        *[uniform(F.col(f"h{g}"), 42, 22).alias(f"b{g}") for g in range(BLOCK // SHARED)],
    )
    scaled = scaled.select(
        *keys, "term", "side", "block",
        *[F.exp(-F.col(f"r{g}") * (F.floor(F.col("ln_w") / F.col(f"r{g}") + F.col(f"b{g}")) - F.col(f"b{g}") + 1.0))
          .alias(f"q{g}") for g in range(BLOCK // SHARED)],
    )
    drawn = scaled.select(
        *keys, "side", "block", *[f"q{g}" for g in range(BLOCK // SHARED)],
        *[F.xxhash64("term", F.col("block") * 64 + k).alias(f"c{k}") for k in range(BLOCK)],
    )
    return drawn.groupBy(*keys, "side", "block").agg(*[
        F.min(-F.log(uniform(F.col(f"c{k}"), 0, 32) * uniform(F.col(f"c{k}"), 32, 32)) * F.col(f"q{k // SHARED}"))
        .alias(f"a{k}") for k in range(BLOCK)
    ])


def signatures(rows, keys, first, second):
    """One row per keys, with the samples of both texts as arrays of numbers; empty for texts without a word.

    Rows of equal keys must be equal. The text of a row never leaves its task: all that follows is grouped by keys.
    """
    least = least_values(weighted_terms(rows, keys, first, second), keys)

    def of(sides):
        """The mark of each draw: a hash of the least value."""
        ours = F.col("side").isin(*sides)
        return [F.min(F.when(ours, F.col(f"a{k}"))) for k in range(BLOCK)]

    both = {"first": of([ONLY_FIRST, BOTH]), "second": of([ONLY_SECOND, BOTH])}
    blocks = least.groupBy(*keys, "block").agg(*[
        value.alias(f"{name}{k}") for name, values in both.items() for k, value in enumerate(values)
    ])

    def marks(name):
        values = F.array(*[F.hash(f"{name}{k}") for k in range(BLOCK)])
        return F.when(F.col(f"{name}0").isNotNull(), values).otherwise(F.array().cast("array<int>")).alias(name)

    blocks = blocks.select(*keys, "block", marks("first"), marks("second"))
    listed = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block", "first", "second"))).alias("_l"))
    return listed.select(*keys, F.flatten("_l.first").alias("first"), F.flatten("_l.second").alias("second"))


def printed(samples):
    """Samples as text: eight hex digits each."""
    return F.array_join(F.transform(samples, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def likeness(one, other):
    """The share of equal samples, 0 to 1: 1 for two texts without a word, 0 where just one has none."""
    equal = F.size(F.filter(F.zip_with(one, other, lambda x, y: x == y), lambda same: same))
    return (
        F.when((F.size(one) == 0) & (F.size(other) == 0), 1.0)
        .when((F.size(one) == 0) | (F.size(other) == 0), 0.0)
        .otherwise(equal / float(SAMPLES))
    )


def sliced(rows, key, slice_rows):
    """rows with coarse and slice, numbers that rise with the key; nulls are in the first.

    Up to EDGES edges are quantiles of the keys; between two edges slices have equal width.
    """
    total = rows.count()
    wanted = max(1, min(SLICES, total // slice_rows))
    parts = min(EDGES, wanted)
    fine = -(-wanted // parts)
    edges = rows.select(F.percentile_approx(key, [k / parts for k in range(parts + 1)], 16 * EDGES)).first()[0] or [0, 0]
    edges = sorted(set(edges))
    edges = edges if len(edges) > 1 else [edges[0], edges[0]]
    inner = edges[1:-1]
    groups = [inner[k:k + EDGE_GROUP] for k in range(0, len(inner), EDGE_GROUP)] or [[]]
    value = F.coalesce(F.col(key), F.lit(edges[0]).cast("long"))

    def numbers(values):
        return F.lit(values).cast("array<bigint>") if values else F.array().cast("array<bigint>")

    # the group of edges first, then the place within it
    group = F.greatest(F.size(F.filter(numbers([g[0] for g in groups if g]), lambda e: e <= value)), F.lit(1))
    rows = rows.withColumn("_group", group)
    lists = F.array(*[numbers(g) for g in groups])
    value = F.coalesce(F.col(key), F.lit(edges[0]).cast("long"))
    inside = F.size(F.filter(F.element_at(lists, F.col("_group")), lambda e: e <= value))
    rows = rows.withColumn("_coarse", (F.col("_group") - 1) * EDGE_GROUP + inside).drop("_group")
    low, high = F.element_at(numbers(edges), F.col("_coarse") + 1), F.element_at(numbers(edges), F.col("_coarse") + 2)
    width = F.greatest(high.cast("double") - low.cast("double"), F.lit(1.0))
    place = F.floor((value.cast("double") - low.cast("double")) / width * fine)
    place = F.least(F.greatest(place, F.lit(0)), F.lit(fine - 1))
    return rows.withColumn("_slice", F.col("_coarse").cast("long") * fine + place)


def with_heads(rows, key, text):
    """rows, and for each slice once more the first row of the slice that follows (after the last: the first slice),
    marked _extra, so that each row finds its follower within its slice."""
    firsts = rows.groupBy("_coarse", "_slice").agg(F.min(F.struct(F.col(key).isNotNull().alias("has"), key)).alias("m"))
    ends = sorted(rows.groupBy("_coarse").agg(F.max("_slice")).collect())
    if not ends:
        return rows.withColumn("_extra", F.lit(False))
    before = {c: ends[k - 1][1] for k, (c, _) in enumerate(ends)}
    before = F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair])
    order = Window.partitionBy("_coarse").orderBy("_slice")
    last = F.coalesce(F.lag("_slice").over(order), F.element_at(before, F.col("_coarse").cast("long")))
    # one row a slice, SLICES at most
    firsts = firsts.select("_slice", F.col(f"m.{key}").alias("_head"), last.alias("_before"))
    heads = (
        rows.join(F.broadcast(firsts), "_slice")
        .where(F.col(key).eqNullSafe(F.col("_head")))
        .groupBy("_coarse", F.col("_before").alias("_slice"), key)
        .agg(F.min(text).alias(text))
        .select(*rows.columns, F.lit(True).alias("_extra"))
    )
    return rows.withColumn("_extra", F.lit(False)).unionByName(heads)


def fingerprints(docs, share=4, doc_id="doc_id", text="text"):
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / share) characters replaced by the first as many, or all, of the next
    document in ascending order of doc_id; after the last comes the first. Rows of equal doc_id follow each other by
    text, a null id comes first, a null text is empty. A text without a word has an empty fingerprint: it is like
    another such text, and unlike all others. Words are runs without ASCII white space, in ASCII lower case.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_heads(sliced(rows, "doc_id", SLICE_ROWS), "doc_id", "text")
    order = Window.partitionBy("_slice").orderBy("_extra", "doc_id", "text")
    rows = rows.select(
        "_slice", "_extra", "doc_id", "text", F.row_number().over(order).alias("_place"),
        F.coalesce(F.lead("text").over(order), F.lit("")).alias("_next"),
    )
    n_chars = F.length("text")
    cut = F.floor(n_chars / share).cast("int")
    rows = rows.withColumns({"n_chars": n_chars.cast("long"), "_cut": cut})
    rows = rows.withColumn(
        "_edited", F.concat(F.expr("substring(text, 1, cast(n_chars as int) - _cut)"), F.expr("substring(_next, 1, _cut)"))
    )
    rows = rows.withColumn("edited_sha256", F.sha2("_edited", 256))
    keys = ["_slice", "_place", "_extra", "doc_id", "n_chars", "edited_sha256"]
    samples = signatures(rows, keys, "text", "_edited")
    after = Window.partitionBy("_slice").orderBy("_place")
    samples = samples.withColumn("_follower", F.lead("first").over(after)).where("not _extra")
    return samples.select(
        "doc_id", "n_chars", "edited_sha256",
        printed(F.col("first")).alias("fingerprint"),
        printed(F.col("second")).alias("edited_fingerprint"),
        likeness(F.col("first"), F.col("second")).alias("near_edited"),
        likeness(F.col("first"), F.col("_follower")).alias("near_next"),
    )
