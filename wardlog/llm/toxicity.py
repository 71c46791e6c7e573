"""Toxicity: a cumulative-link ordinal regression over sparse word features.

A word counts by itself and by its beginnings, as insults are inflected. Grades 0 to 3 are ordered; all thresholds
share one weight vector, P(grade <= j) = logistic(threshold_j - weights . features), and a document's severity is its
expected grade.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wardlog.llm.arrow import map_batches, term_list, texts, with_columns
from wardlog.llm.tables import stored

TRAIN_ROWS = 12_000
FEATURES = 4_000
LEAST_DOCUMENTS = 4
BEGINNINGS = (4, 5, 6, 7)
GRADES = 4
REJECT_FROM = 0.6

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("severity", pa.float64()), ("grade", pa.int32()), ("toxic", pa.bool_()),
])
RESULT = "doc_id long, severity double, grade int, toxic boolean"


def word_features(word):
    """The word, closed by a blank, and its beginnings."""
    return [word + b" ", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def document_features(text, known=None):
    """Distinct features of a text, or of the known ones only."""
    found = {feature for word in set(term_list(text)) for feature in word_features(word)}
    return found if known is None else found & known


def training_rows(docs, labels, rows):
    """doc_id, toxic and text of at most `rows` labelled documents, chosen by hash."""
    ids = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return stored(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "toxicity-train")  # TRAIN_ROWS ids


def feature_counts(train):
    """Documents with each feature, toxic and all; summed per task first, rare ones dropped at the end."""

    def count(batches):
        totals = {}
        for batch in batches:
            for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist()):
                for feature in document_features(text):
                    pair = totals.setdefault(feature, [0, 0])
                    pair[0] += 1
                    pair[1] += toxic > 0
            if len(totals) > 500_000:
                yield flush(totals)
                totals = {}
        if totals:
            yield flush(totals)

    def flush(totals):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.binary()), pa.array([p[0] for p in totals.values()], pa.int64()),
             pa.array([p[1] for p in totals.values()], pa.int64())],
            names=["feature", "n", "n_toxic"],
        )

    return (
        train.select("text", "toxic")
        .transform(map_batches, count, "feature binary, n long, n_toxic long")
        .groupBy("feature")
        .agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
        .where(F.col("n_toxic") >= LEAST_DOCUMENTS)
    )


def choose_features(train, n_rows, n_toxic, features):
    """Features that stand in toxic documents far more often than elsewhere: the largest z values of the
    difference in share. At most `features` of them reach the driver."""
    other = n_rows - n_toxic
    share, rest = F.col("n_toxic") / n_toxic, (F.col("n") - F.col("n_toxic")) / other
    both = F.col("n") / n_rows
    z = (share - rest) / F.sqrt(both * (1 - both) * (1 / n_toxic + 1 / other) + 1e-12)
    rows = (
        feature_counts(train)
        .withColumn("z", z)
        .where("z > 4")
        .orderBy(F.desc("z"), "feature")
        .limit(features)
        .collect()
    )
    return [bytes(row["feature"]) for row in rows]


def training_matrix(train, chosen):
    """(toxic, feature numbers) of each training document; bounded by the sample and the features."""
    numbers = {feature: i for i, feature in enumerate(chosen)}
    known = frozenset(numbers)

    def encode(batches):
        for batch in batches:
            found = [sorted(numbers[f] for f in document_features(t, known)) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("toxic").cast(pa.int32()),
                 pa.array(found, pa.list_(pa.int32()))],
                names=["doc_id", "toxic", "found"],
            )

    rows = train.select("doc_id", "toxic", "text").transform(map_batches, encode, "doc_id long, toxic int, found array<int>")
    return sorted((r["doc_id"], r["toxic"], tuple(r["found"])) for r in rows.collect())


def graded(rows):
    """Severity grades of the training rows: 0 if not toxic, else 1 to 3 by thirds of the number of features."""
    sizes = sorted(len(found) for _, toxic, found in rows if toxic > 0)
    cuts = [sizes[len(sizes) * i // 3] for i in (1, 2)] if sizes else [0, 0]
    return [0 if toxic <= 0 else 1 + sum(len(found) > cut for cut in cuts) for _, toxic, found in rows]


def fit(rows, n_features, rounds=400, penalty=1e-4):
    """Weights and ordered thresholds by gradient steps (Adam) on the penalised log-likelihood."""
    grade = np.array(graded(rows))
    length = np.array([len(found) for *_, found in rows])
    row = np.repeat(np.arange(len(rows)), length)
    column = np.fromiter((i for *_, found in rows for i in found), np.int64, int(length.sum()))
    balance = np.where(grade > 0, 0.5 / max((grade > 0).mean(), 1e-9), 0.5 / max((grade == 0).mean(), 1e-9))
    # parameters: weights, first threshold, logs of the gaps between thresholds
    point = np.concatenate([np.zeros(n_features), [1.0], np.zeros(GRADES - 2)])
    mean, square = np.zeros_like(point), np.zeros_like(point)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, rounds + 1):
        weights, gaps = point[:n_features], np.exp(point[n_features + 1:])
        cuts = np.concatenate([[-np.inf], point[n_features] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        score = np.bincount(row, weights[column], len(rows))
        upper, lower = sigmoid(cuts[grade + 1] - score), sigmoid(cuts[grade] - score)
        chance = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = balance * upper * (1 - upper) / chance, balance * lower * (1 - lower) / chance
        d_cuts = np.zeros(GRADES + 1)
        np.add.at(d_cuts, grade + 1, d_upper)
        np.add.at(d_cuts, grade, -d_lower)
        d_cuts = d_cuts[1:GRADES]
        slope = np.concatenate([
            np.bincount(column, (d_lower - d_upper)[row], n_features),
            [d_cuts.sum()],
            [d_cuts[i + 1:].sum() * gaps[i] for i in range(GRADES - 2)],
        ]) / len(rows)
        slope[:n_features] -= penalty * weights
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope ** 2
        point = point + 0.1 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    gaps = np.exp(point[n_features + 1:])
    return point[:n_features], point[n_features] + np.concatenate([[0], np.cumsum(gaps)])


def severities(scores, cuts):
    """Expected grade and most likely grade."""
    below = 1 / (1 + np.exp(-np.clip(cuts[None, :] - scores[:, None], -40, 40)))
    chances = np.diff(np.concatenate([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))], axis=1), axis=1)
    return chances @ np.arange(GRADES), chances.argmax(axis=1)


def severity_model(docs, labels, train_rows=TRAIN_ROWS, features=FEATURES):
    """A function from texts to (severity, grade), fitted on at most train_rows labelled documents."""
    train = training_rows(docs, labels, train_rows)
    counts = {True: 0, False: 0}
    for row in train.groupBy("toxic").count().collect():
        counts[row["toxic"] > 0] += row["count"]
    chosen = []
    if counts[True] and counts[False]:
        chosen = choose_features(train, sum(counts.values()), counts[True], features)
    if not chosen:
        return lambda found: (np.zeros(len(found)), np.zeros(len(found), int))
    weights, cuts = fit(training_matrix(train, chosen), len(chosen))
    numbers = {feature: i for i, feature in enumerate(chosen)}
    known = frozenset(numbers)

    def judge(found):
        listed = ([numbers[f] for f in document_features(text, known)] for text in found)
        return severities(np.array([weights[sorted(i)].sum() if i else 0.0 for i in listed]), cuts)

    return judge


def toxicity(docs, labels, train_rows=TRAIN_ROWS, features=FEATURES, reject_from=REJECT_FROM):
    """One row per document row: severity (expected grade), grade (the likeliest) and toxic.

    docs has doc_id and text, labels doc_id and toxic (0 or 1, the largest if a document has several); other columns
    are ignored. Null or empty texts have no features and the severity of a text without any. Rows that repeat are
    judged alike. Without toxic labels, or without others, no model can be fitted: severity and grade are 0. An empty
    table gives no rows.
    """
    judge = severity_model(docs, labels, train_rows, features)

    def predict(batches):
        for batch in batches:
            severity, grade = judge(texts(batch))
            yield with_columns(batch, ["doc_id"], SCHEMA, severity=severity, grade=grade,
                               toxic=severity >= reject_from)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").transform(map_batches, predict, RESULT)


def without_toxic(docs, labels, train_rows=TRAIN_ROWS, features=FEATURES, reject_from=REJECT_FROM):
    """The documents below reject_from, with all their columns."""
    judge = severity_model(docs, labels, train_rows, features)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(judge(texts(batch))[0] < reject_from))

    return docs.transform(map_batches, keep, docs.schema)
