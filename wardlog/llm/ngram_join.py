"""Exact Jaccard join of documents on word n-grams, and its connected groups.

Jaccard distance is a metric, but texts that share nothing are all at distance 1, where no pivot tells them apart.
So regions are found from the bottom. The space of n-grams is halved again and again by hash. If two sets are similar
enough, so are their parts in some half; and where few n-grams are left, that means the parts are equal. A
document therefore joins the regions of its small parts, at a boundary those of both levels, and similar documents
share a region for certain. Inside regions, bitmaps bound the distance from below; what remains is gathered into
neighbourhoods. Those are joined with pivots: each document goes to the Voronoi region of its nearest pivot and, where
the triangle inequality lets a similar document lie across the border, to the neighbouring regions too. Regions are
divided in turn until they are small, and are then compared exactly.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlog.llm.arrow import LOWER_BYTES, in_steps, map_batches
from wardlog.llm.joins import components, lookup
from wardlog.llm.tables import stored

WORDS = 4
PERCENT = 85
REGION_ROWS = 4096  # documents compared in one task
REGION_GRAMS = 4_000_000  # and their n-grams
PIVOTS = 8
LEAF = 48
ROUNDS = 3
BROADCAST_IDS = 2_000_000
SEEN = 200_000
ROW = "_near_row"

U64 = np.uint64
ODD = [U64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                        0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def mixed(x):
    """Spreads each 64-bit value over all bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def gram_set(text, width):
    """Sorted hashes of the distinct word n-grams; a text of fewer words is one n-gram, one without words none."""
    words = text.encode().translate(LOWER_BYTES).split()
    if not words:
        return np.empty(0, U64)
    hashes = np.array([xxhash.xxh3_64_intdigest(word) for word in words], U64)
    n = min(width, len(words))
    total = np.full(len(words) - n + 1, n, U64)
    for i in range(n):
        total += mixed(hashes[i:len(hashes) - n + 1 + i] * ODD[i % 8] + U64(i))
    return np.unique(mixed(total))


def set_key(grams):
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def part_rule(percent):
    """(most n-grams in a union whose parts must be equal, fewest in a part of its parent).

    Sets of a union of u that differ have a similarity of (u - 1) / u at most.
    """
    most = 99 // (100 - percent)
    return most, -(-percent * (most + 1) // 100)


def part_signatures(sets, percent):
    """(index of the set, signature) of every part to join on; sets are sorted hashes.

    Level d cuts by the leading d bits. A part counts if it has at most `most` n-grams and its parent at least
    `fewest`: for similar sets, the first level on which the similar halves have so small a union is such a part of both.
    """
    most, fewest = part_rule(percent)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    grams = np.concatenate(sets) if len(sets) else np.empty(0, U64)
    weight = mixed(grams * ODD[4])
    parent = np.repeat(sizes, sizes)
    owners, signatures = [], []
    for level in range(65):
        if not len(grams):
            break
        prefix = grams >> U64(64 - level) if level else np.zeros(len(grams), U64)
        starts = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (prefix[1:] != prefix[:-1])])
        size = np.diff(np.r_[starts, len(grams)])
        small = (size <= most) & ((level == 0) | (parent[starts] >= fewest))
        if small.any():
            total = np.add.reduceat(weight, starts)[small]
            owners.append(owner[starts][small])
            signatures.append(mixed(total + U64(level * int(ODD[5]) & 0xFFFFFFFFFFFFFFFF)))
        of_gram = np.repeat(size, size)
        go_on = of_gram >= fewest
        owner, grams, weight, parent = owner[go_on], grams[go_on], weight[go_on], of_gram[go_on]
    if not owners:
        return np.empty(0, np.int64), np.empty(0, U64)
    return np.concatenate(owners), np.concatenate(signatures)


def bitmap(grams):
    """A bit per n-gram, by its low bits; about four times as many bits as n-grams, a power of two."""
    bits = max(256, 1 << (4 * len(grams) - 1).bit_length())
    marks = np.zeros(bits, bool)
    marks[(grams & U64(bits - 1)).astype(np.int64)] = True
    return np.packbits(marks, bitorder="little").tobytes()


def folded(bits, size):
    """The bitmap of the same n-grams with `size` bytes."""
    data = np.frombuffer(bits, np.uint8)
    while len(data) > size:
        data = data[:len(data) // 2] | data[len(data) // 2:]
    return data.view(U64)


def allowed(sizes, size, percent):
    """Most n-grams in which sets of these sizes may differ."""
    return (100 - percent) * (sizes + size) // (100 + percent)


def document_sets(docs, width, percent):
    """doc_id, n_shingles, key of the set, and of its first occurrence in a task: bitmap and signatures.

    Copies within a task need no signatures of their own, so that a text that is a third of all rows joins once per
    task.
    """

    def measure(batches):
        seen = set()
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
            for step in in_steps((row, len(row[1] or "")) for row in rows):
                yield measured(step, seen)

    def measured(rows, seen):
        sets = [gram_set(text or "", width) for _, text in rows]
        keys = [set_key(grams) for grams in sets]
        parts, bits, fresh = [None] * len(rows), [None] * len(rows), []
        if len(seen) > SEEN:
            seen.clear()
        for place, key in enumerate(keys):
            if len(sets[place]) and key not in seen:
                seen.add(key)
                fresh.append(place)
        owner, signatures = part_signatures([sets[place] for place in fresh], percent)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(fresh) + 1))
        signatures = signatures[order].view(np.int64)
        for i, place in enumerate(fresh):
            parts[place], bits[place] = signatures[cuts[i]:cuts[i + 1]], bitmap(sets[place])
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in rows], pa.int64()), pa.array([len(g) for g in sets], pa.int64()),
             pa.array(keys, pa.binary()), pa.array(bits, pa.binary()), pa.array(parts, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "key", "bits", "parts"],
        )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").transform(
        map_batches, measure, "doc_id long, n_shingles long, key binary, bits binary, parts array<long>"
    )


def node_of(key):
    """A 64-bit name of a set; if two sets have one name, both are compared under it, so results do not depend on it."""
    return F.xxhash64(key)


def shared_regions(sets):
    """(region, node): the documents that share a part, once for all parts shared by the same documents."""
    rows = sets.where("parts is not null").select(node_of("key").alias("node"), F.explode("parts").alias("part"))
    order = Window.partitionBy("part").orderBy("node")
    group = Window.partitionBy("part")
    return (
        rows.withColumn("before", F.lag("node").over(order))
        .where("before is null or before <> node")
        .withColumn("members", F.count("*").over(group))
        .where("members > 1")
        .withColumn("region", F.bit_xor(F.xxhash64("node")).over(group))
        .select(F.xxhash64("region", "members").alias("region"), "node")
        .distinct()
    )


def size_bands(regions, percent):
    """Splits regions by size: a document goes to the band of its size and to the next, where a larger one similar to it may be."""
    step = float(np.log(100 / percent)) * (1 + 1e-9)  # rounding must not put similar sizes two bands apart
    band = F.floor(F.log(F.col("n_shingles")) / step)
    return regions.withColumn("band", F.explode(F.array(band, band + 1))).withColumn(
        "region", F.xxhash64("region", "band")
    ).drop("band")


def voronoi(percent):
    """A function over batches of rows with their region's pivots: one row per region the document goes to."""

    def assign(batches):
        for batch in batches:
            out = {name: [] for name in ("region", "node", "n_shingles", "bits")}
            for row in batch.to_pylist():
                size = row["width"]  # one width per region, so that all its distances compare
                own = folded(row["bits"], size)
                apart = np.array([int(np.bitwise_count(own ^ folded(p, size)).sum()) for p in row["pivot_bits"]])
                # twice the largest distance of a similar pair: a similar document's home may be that much farther
                reach = 2 * int(allowed(row["most"], row["most"], percent))
                for place in np.flatnonzero(apart <= apart.min() + reach):
                    out["region"].append(xxhash.xxh3_64_intdigest(f"{row['region']}:{place}") - (1 << 63))
                    for name in ("node", "n_shingles", "bits"):
                        out[name].append(row[name])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["region"], pa.int64()), pa.array(out["node"], pa.int64()),
                 pa.array(out["n_shingles"], pa.int64()), pa.array(out["bits"], pa.binary())],
                names=list(out),
            )

    return assign


REGION_ROW = "region long, node long, n_shingles long, bits binary"


def bounded_regions(regions, percent, name, most_rows=REGION_ROWS, most_grams=REGION_GRAMS):
    """The same regions, the large ones divided until each fits into a task.

    Rows are region, node, n_shingles, bits. A large region is first cut by size, then by pivots: the nearest pivot's
    region, and all whose pivot is so little farther that a similar document may be at home there. What does not
    shrink so is cut into blocks, and every pair of blocks is a region. No similar pair is ever separated.
    """
    done = None
    for step in range(ROUNDS + 2):
        sizes = regions.groupBy("region").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("grams"),
                                              F.max("n_shingles").alias("most"), F.min(F.octet_length("bits")).alias("width"))
        large = stored(sizes.where((F.col("rows") > most_rows) | (F.col("grams") > most_grams)), name)
        count = large.count()
        if not count:
            return regions if done is None else done.unionByName(regions)
        told = lookup(regions, large, "region", "node", count)
        small = told.where("rows is null").select(*regions.columns)
        done = small if done is None else done.unionByName(small)
        wide = told.where("rows is not null")
        if step == 0:
            divided = size_bands(wide, percent).select(*regions.columns)
        elif step < ROUNDS:
            # pivots: the first documents of a region in hash order, PIVOTS of them
            order = Window.partitionBy("region").orderBy(F.xxhash64("node", F.lit(step)), "node")
            chosen = (
                wide.withColumn("place", F.row_number().over(order))
                .where(F.col("place") <= PIVOTS)
                .groupBy("region")
                .agg(F.sort_array(F.collect_list(F.struct("place", "bits"))).alias("chosen"))
                .select("region", F.col("chosen.bits").alias("pivot_bits"))
            )
            with_pivots = lookup(wide.select(*regions.columns, "most", "width"), chosen, "region", "node", count)
            divided = with_pivots.select(*regions.columns, "most", "pivot_bits", "width").transform(
                map_batches, voronoi(percent), REGION_ROW
            )
        else:
            blocks = F.greatest(F.ceil(2 * F.col("rows") / most_rows), F.ceil(2 * F.col("grams") / most_grams)).cast("int")
            own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
            divided = (
                wide.withColumn("blocks", F.greatest(blocks, F.lit(2)))
                .withColumn("own", own)
                .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                .withColumn("region", F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")))
                .select(*regions.columns)
            )
            return done.unionByName(divided)
        regions = stored(divided, name)


class Groups:
    """Union-find over places 0 .. n - 1; links are those that joined two groups."""

    def __init__(self, n):
        self.root, self.links = list(range(n)), []

    def find(self, i):
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i, j):
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)
            self.links.append((i, j))


def absorb(places, near, groups):
    """Joins all that are connected: each member reached takes those that are near it out of the rest."""
    rest = np.asarray(places)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            close = near(x, rest)
            for y in rest[close]:
                groups.join(int(x), int(y))
            queue.extend(rest[close])
            rest = rest[~close]


def bitmap_links(sizes, bitmaps, percent):
    """Links that connect all whose bitmaps allow a similarity, level by level of bitmap width."""
    groups, widths = Groups(len(sizes)), np.array([len(b) for b in bitmaps])
    for width in np.unique(widths):
        # neighbours in size have bitmaps of this width or twice it
        places = np.flatnonzero((widths == width) | (widths == 2 * width))
        table = np.zeros((len(sizes), width // 8), U64)
        for i in places:
            table[i] = folded(bitmaps[i], width)

        def near(x, rest):
            close = allowed(sizes[rest], sizes[x], percent) >= np.abs(sizes[rest] - sizes[x])
            apart = np.bitwise_count(table[rest[close]] ^ table[x]).sum(axis=1)
            close[close] = apart <= allowed(sizes[rest[close]], sizes[x], percent)
            return close

        absorb(places, near, groups)
    return groups.links


class ExactRegion:
    """Exact Jaccard links of sets within a region, by pivots and recursion."""

    def __init__(self, sets, percent):
        self.sizes = np.array([len(s) for s in sets])
        grams, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        self.codes, self.n_codes, self.percent = inverse.astype(np.int32), len(grams), percent
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        self.groups = Groups(len(sets))
        self.mark = np.zeros(self.n_codes, bool)

    def common(self, x, others):
        """Sizes of the intersections of x with others."""
        own = self.codes[self.starts[x]:self.starts[x + 1]]
        self.mark[own] = True
        lengths = self.sizes[others]
        ends = np.cumsum(lengths)
        index = np.arange(ends[-1]) + np.repeat(self.starts[others] - (ends - lengths), lengths)
        hits = np.add.reduceat(self.mark[self.codes[index]].astype(np.int64), ends - lengths)
        self.mark[own] = False
        return hits

    def distances(self, x, others):
        hits = self.common(x, others)
        return 1 - hits / (self.sizes[others] + self.sizes[x] - hits)

    def near(self, x, rest):
        close = 100 * np.minimum(self.sizes[rest], self.sizes[x]) >= self.percent * np.maximum(self.sizes[rest], self.sizes[x])
        if close.any():
            hits = self.common(x, rest[close])
            close[close] = 100 * hits >= self.percent * (self.sizes[rest[close]] + self.sizes[x] - hits)
        return close

    def join(self, places):
        """Links of the places: regions of the nearest pivots, with what may have a similar document there."""
        if len(places) <= LEAF:
            return absorb(places, self.near, self.groups)
        pivots, apart = [places[0]], [self.distances(places[0], places)]
        while len(pivots) < PIVOTS:
            pivots.append(places[int(np.argmax(np.min(apart, axis=0)))])
            apart.append(self.distances(pivots[-1], places))
        apart = np.array(apart)
        reach = apart.min(axis=0) + 2 * (1 - self.percent / 100) + 1e-9
        regions = [places[row <= reach] for row in apart]
        if sum(len(r) for r in regions) > 2 * len(places) or max(map(len, regions)) > 0.9 * len(places):
            return absorb(places, self.near, self.groups)  # pivots do not tell these apart
        for region in regions:
            self.join(region)


def region_batches(batches, columns):
    """Rows grouped by region, from batches sorted by region; a region may go over several batches."""
    region, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ["region", *columns])):
            if row[0] != region:
                if len(rows) > 1:
                    yield rows
                region, rows = row[0], []
            rows.append(row[1:])
    if len(rows) > 1:
        yield rows


def in_regions(frame, function, columns, result):
    """Applies function (rows of a region -> links) region by region; regions are bounded beforehand."""

    def run(batches):
        found_a, found_b = [], []
        for rows in region_batches(batches, columns):
            for a, b in function(rows):
                found_a.append(a)
                found_b.append(b)
            if len(found_a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())],
                                                 names=["a", "b"])
                found_a, found_b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    rows = frame.select("region", *columns).repartition("region").sortWithinPartitions("region")
    return rows.transform(map_batches, run, result)


def candidate_links(regions, percent):
    def link(rows):
        rows = sorted(set(rows))
        sizes = np.array([n for _, n, _ in rows])
        return ((rows[i][0], rows[j][0]) for i, j in bitmap_links(sizes, [b for *_, b in rows], percent))

    return in_regions(regions, link, ["node", "n_shingles", "bits"], "a long, b long")


def exact_links(regions, width, percent):
    def link(rows):
        members = {}
        for doc_id, key, text in rows:
            grams = gram_set(text, width)
            if set_key(grams) == key:  # another row of this doc_id may have another text
                members[(doc_id, key)] = grams
        names = sorted(members)
        if len(names) < 2:
            return []
        region = ExactRegion([members[name] for name in names], percent)
        region.join(np.arange(len(names)))
        return ((names[i][0], names[j][0]) for i, j in region.groups.links)

    return in_regions(regions, link, ["doc_id", "key", "text"], "a long, b long")


def ngram_join(docs, width=WORDS, percent=PERCENT, region_rows=REGION_ROWS, region_grams=REGION_GRAMS):
    """One row per document row: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    docs has doc_id and text; other columns are ignored. Two documents link if their sets of word n-grams have a Jaccard
    similarity of percent / 100 or more. A text without words has no n-gram and links with nothing. Rows of one doc_id are
    one document. A row without doc_id links with nothing, and its component_id is null. An empty table gives no rows.
    """
    sets = stored(document_sets(docs, width, percent), "ngram-sets")
    named = sets.where("n_shingles > 0 and doc_id is not null")
    facts = (
        named.groupBy("key")
        .agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
        .withColumn("node", node_of("key"))
    )
    shared = stored(shared_regions(named), "ngram-regions")
    bits = (
        named.where("bits is not null")
        .groupBy("key", "n_shingles")
        .agg(F.min("bits").alias("bits"))
        .select(node_of("key").alias("node"), "n_shingles", "bits")
    )
    members = stored(shared.join(bits, "node").select("region", "node", "n_shingles", "bits"), "ngram-members")
    near = candidate_links(bounded_regions(members, percent, "ngram-part", region_rows, region_grams), percent)
    blocks = stored(components(near.distinct(), "ngram-near"), "ngram-blocks")

    hoods = stored(
        blocks.join(bits, "node").select(F.col("component").alias("region"), "node", "n_shingles", "bits"), "ngram-hoods"
    )
    regions = stored(
        bounded_regions(hoods, percent, "ngram-hood", region_rows, region_grams).select("region", "node").distinct()
        .join(facts.select("node", "key", "first"), "node")
        .select("region", "key", F.col("first").alias("doc_id")),
        "ngram-exact",
    )
    ids = regions.select("doc_id").distinct()
    texts = (
        docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(text, '') text")
        .join(few(ids), "doc_id", "left_semi")
        .dropDuplicates(["doc_id", "text"])
    )
    links = exact_links(regions.join(texts, "doc_id"), width, percent)
    groups = components(links, "ngram-links")

    # a set's component, told to its documents where it differs from their own id
    told = (
        facts.join(groups, facts["first"] == groups["node"], "left")
        .select("key", "first", "copies", F.coalesce("component", "first").alias("component_id"))
        .where("copies > 1 or component_id <> first")
        .select("key", "component_id")
    )
    rows = lookup(sets.select("doc_id", "n_shingles", "key"), stored(told, "ngram-told"), "key", "doc_id")
    return rows.select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def without_near_duplicates(docs, width=WORDS, percent=PERCENT):
    """The rows of docs, all columns, but only one row of each group of linked texts.

    It is the row with the smallest doc_id; of several with that id, or of a group without ids, the first as stored. Rows
    are decided one by one, whatever their id: two unrelated texts under one doc_id both stay, of two equal ones under
    two ids, one id or none, one stays. Rows without a word all stay. An empty table gives no rows.
    """
    rows = stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "near-rows")
    groups = ngram_join(rows.select(F.col(ROW).alias("doc_id"), "text"), width, percent)
    groups = stored(groups.select(F.col("doc_id").alias(ROW), F.col("component_id").alias("_group")), "near-groups")
    shared = groups.groupBy("_group").count().where("count > 1").select("_group")
    members = groups.join(shared, "_group").join(rows.select(ROW, "doc_id"), ROW)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", ROW)
    kept = members.groupBy("_group").agg(F.min(place)[ROW].alias(ROW)).select(ROW)
    dropped = stored(members.select(ROW).join(kept, ROW, "left_anti"), "near-dropped")
    return rows.join(few(dropped), ROW, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def few(ids):
    """Broadcast up to BROADCAST_IDS rows, joined by a shuffle beyond."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
