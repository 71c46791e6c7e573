"""Language identification by error-correcting output codes.

Each language has a codeword of bits. One binary classifier per bit, a log-likelihood ratio of hashed byte 4-grams,
says which half of the languages a text belongs to. The codeword with the least weighted loss wins; a small lead
over the second is flagged.
"""

import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlog.llm.arrow import map_batches, texts, with_columns

TRAIN_DOCS = 1_000
SHARES = 32
HELD_LANGUAGES = 256  # dense counts that a task holds before it hands them on
BLOCK_LANGUAGES = 64  # languages that the driver spreads out at a time
BROADCAST_IDS = 1_000_000
BUCKET_BITS = 16
EXHAUSTIVE = 7
AMBIGUOUS = 0.75
STEP = 1 << 20
STEP_ROWS = 1_000
CELLS = 1 << 23  # weights that are gathered at a time

LETTER = regex.compile(r"\p{L}")
GRAM_BYTES = bytes(32 if b < 128 and not 97 <= b <= 122 else b for b in range(256))
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()),
    ("ambiguous", pa.bool_()),
])
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"


def gram_hashes(text):
    """Buckets of the byte 4-grams of a text in lower case; what is no letter is blank. None are left out."""
    data = np.frombuffer(b" " + text.lower().encode().translate(GRAM_BYTES) + b"   ", np.uint8)
    for start in range(0, len(data) - 3, STEP):
        part = data[start:start + STEP + 3].astype(np.uint32)
        grams = part[:-3] | part[1:-2] << 8 | part[2:-1] << 16 | part[3:] << 24
        yield (grams * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


def held_out(column="doc_id"):
    """Documents kept from training."""
    return F.crc32(F.col(column).cast("string")) % 3 == 1


def training_counts(docs, per_language):
    """{language: (buckets, counts)}, over at most per_language documents of each language, by hash."""
    usable = docs.where(~F.coalesce(held_out(), F.lit(False)) & F.col("lang").isNotNull())
    few = usable.select("lang").distinct().count() * per_language <= BROADCAST_IDS
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ranked = usable.where("doc_id is not null").select("doc_id", "lang", F.pmod(F.hash("doc_id"), F.lit(SHARES)).alias("share"))
    # within shares first, so that no task gets more than per_language rows of each share of a language
    for keys in (["lang", "share"], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        ranked = ranked.where(F.col("rank") <= per_language)
    ids = ranked.select("doc_id", F.col("lang").alias("train_lang")).distinct()
    ids = F.broadcast(ids) if few else ids
    rows = usable.select("doc_id", "lang", "text").join(ids, "doc_id").where("lang = train_lang")

    def sparse(totals):
        for language, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(used), pa.string()), pa.array(used, pa.int32()),
                 pa.array(total[used], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    def count(batches):
        totals = {}
        for batch in batches:
            for text, language in zip(texts(batch), batch.column("lang").to_pylist()):
                if len(totals) == HELD_LANGUAGES and language not in totals:
                    yield from sparse(totals)
                    totals = {}
                total = totals.setdefault(language, np.zeros(1 << BUCKET_BITS, np.int64))
                for hashes in gram_hashes(text):
                    total += np.bincount(hashes, minlength=1 << BUCKET_BITS)
        yield from sparse(totals)

    counted = rows.select("lang", "text").transform(map_batches, count, "lang string, bucket int, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(
        F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("counts")  # at most 2 ** BUCKET_BITS
    )
    found = table.toArrow()
    return {
        language: (found["buckets"][k].values.to_numpy(), found["counts"][k].values.to_numpy())
        for k, language in enumerate(found["lang"].to_pylist())
    }


def spread(counts):
    """Sparse counts as one number per bucket."""
    dense = np.zeros(1 << BUCKET_BITS)
    dense[counts[0]] = counts[1]
    return dense


def nearest(code, start):
    """The largest product of a row from ``start`` on with another row."""
    part = code[start:start + STEP_ROWS] @ code.T
    part[np.arange(len(part)), start + np.arange(len(part))] = -np.inf
    return part.max()


def codewords(languages):
    """One row of +1 and -1 per language; every column splits the languages.

    Up to EXHAUSTIVE languages all splits are used; beyond, the widest of 200 seeded random codes.
    """
    n = len(languages)
    if n <= EXHAUSTIVE:
        columns = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, dtype=float).T if columns else np.ones((n, 1))
    rng, best = np.random.default_rng(11), None
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        near = max(nearest(code, start) for start in range(0, n, STEP_ROWS))
        if best is None or near < best[0]:
            best = (near, code)
    return best[1]


def bit_weights(counts, code):
    """Log-likelihood ratio of each bucket for each bit: the languages of a side weigh alike."""
    plus, minus = (np.zeros((code.shape[1], 1 << BUCKET_BITS)) for _ in range(2))
    for row, word in zip(counts, code):
        dense = spread(row)
        law = (dense + 0.5) / (dense.sum() + 0.5 * len(dense))
        plus[word > 0] += law
        minus[word < 0] += law
    weights = np.empty((1 << BUCKET_BITS, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        n_plus, n_minus = (code[:, bit] > 0).sum(), (code[:, bit] < 0).sum()
        weights[:, bit] = np.log(plus[bit] / n_plus) - np.log(minus[bit] / n_minus) if n_minus else 1.0
    return weights


def margins_of(counts, weights):
    """Mean weight of each bit over the counted texts of each language."""
    parts = []
    for start in range(0, len(counts), BLOCK_LANGUAGES):
        dense = [spread(row) for row in counts[start:start + BLOCK_LANGUAGES]]
        parts.append(np.array([row / max(row.sum(), 1) for row in dense]) @ weights)
    return np.concatenate(parts)


def decode(margins, code, trust):
    """Language number, its share and whether the second is near: the least weighted logistic loss wins."""
    loss = (trust * np.log1p(np.exp(-np.clip(code * margins, -40, 40)))).sum(axis=1)
    order = np.argsort(loss, kind="stable")
    shares = np.exp(-(loss - loss[order[0]]))
    shares /= shares.sum()
    return order[0], float(shares[order[0]]), len(order) > 1 and shares[order[0]] < AMBIGUOUS


def identify(docs, per_language=TRAIN_DOCS):
    """One row per document row: held_out, lang_pred, score (0 to 1) and ambiguous.

    docs has doc_id, text and lang; other columns are ignored, and lang only serves the training rows, which are those
    not held out. A null text or one without a letter is `und` with score 0, as is every text if no language could
    be learned. Rows that repeat are judged alike; a null doc_id is not held out and not learned from. Equal losses go to the first
    language in order. An empty table gives no rows.
    """
    learned = training_counts(docs, per_language)
    languages = sorted(learned)
    if languages:
        code = codewords(languages)
        counts = [learned[name] for name in languages]
        weights = bit_weights(counts, code)
        # a bit counts by how far its classifier separates the learned languages
        apart = (margins_of(counts, weights) * code).min(axis=0)
        trust = np.maximum(apart, 1e-3) / max(apart.max(), 1e-3)
        step = max(1, CELLS // code.shape[1])
        scale = 4.0 / max(float(np.median(np.maximum(apart, 1e-3))), 1e-3)

    def predict(batches):
        for batch in batches:
            names, scores, near = [], [], []
            for text in texts(batch):
                if not languages or not LETTER.search(text):
                    names.append("und"), scores.append(0.0), near.append(False)
                    continue
                total, n = np.zeros(code.shape[1]), 0
                for hashes in gram_hashes(text):
                    for start in range(0, len(hashes), step):
                        total += weights[hashes[start:start + step]].sum(axis=0, dtype=np.float64)
                    n += len(hashes)
                best, share, close = decode(scale * total / n, code, trust)
                names.append(languages[best]), scores.append(share), near.append(bool(close))
            yield with_columns(batch, ["doc_id", "held_out"], SCHEMA, lang_pred=names, score=scores, ambiguous=near)

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text"
    ).transform(map_batches, predict, RESULT)
