"""Fill-in-middle transformation: a text is cut twice between units and its parts are put in another order.

The cuts are found on a wavelet matrix over character classes: the ranks of the classes that end a unit add up to the
number of boundaries before any place, and bisection on these ranks finds the place behind a given boundary.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlog.llm.arrow import map_batches
from wardlog.llm.wavelet import BLANK, END, NEWLINE, WaveletMatrix

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
# the classes of which each byte ends a unit; a unit goes up to and with it, or to the end of the text
UNITS = {"lines": (NEWLINE,), "sentences": (NEWLINE, END), "words": (NEWLINE, BLANK)}
SEED = 7
STEP_BYTES = 1 << 20
NEW = "_fim"


def draws(doc_id, seed):
    """Four unsigned 32-bit numbers, the first groups of the hash of seed and id (nothing for a null id)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def cuts_of(data, starts, ends, first, second, kinds):
    """Units of each text, and the characters before its lower and its upper cut."""
    matrix = WaveletMatrix(data)
    before = matrix.count(kinds, starts)
    inside = matrix.count(kinds, ends) - before
    # what stands behind the last boundary is a unit too
    last = matrix.after(kinds, before + inside, starts, ends)
    units = inside + (last < ends)
    draw = np.sort(np.stack([first % (units + 1), second % (units + 1)]), axis=0)
    characters = matrix.characters(starts)
    places = []
    for wanted in draw:
        found = matrix.after(kinds, before + np.minimum(wanted, inside), starts, ends)
        places.append(matrix.characters(np.where(wanted > inside, ends, found)) - characters)
    return units, *places


def with_cuts(docs, kinds):
    """Adds units and cuts, as the numbers _fim_n, _fim_low and _fim_high, to rows with _fim_text, _fim_1 and _fim_2."""
    added = [f"{NEW}_n", f"{NEW}_low", f"{NEW}_high"]

    def cut(batches):
        for batch in batches:
            texts = batch.column(f"{NEW}_text").cast(pa.large_binary())
            _, offsets, values = texts.buffers()
            offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
            data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
            first, second = (batch.column(f"{NEW}_{k}").to_numpy(zero_copy_only=False) for k in (1, 2))
            found, row = [np.zeros(len(texts), np.int64) for _ in added], 0
            while row < len(texts):
                # neighbouring texts share a matrix, up to some size
                end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + STEP_BYTES, "right")) - 1)
                base = offsets[row]
                places = offsets[row:end + 1] - base
                part = data[base:offsets[end]]
                cuts = cuts_of(part, places[:-1], places[1:], first[row:end], second[row:end], kinds)
                for column, cut_places in zip(found, cuts):
                    column[row:end] = cut_places
                row = end
            columns = [*batch.columns, *(pa.array(column) for column in found)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *added])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, T.LongType()) for name in added)])
    return docs.transform(map_batches, cut, schema)


def fill_in_middle(docs, units="lines", percent=100, spm_percent=50, seed=SEED, text="text", doc_id="doc_id"):
    """Adds n (units of the text), form, prefix_chars, middle_chars and output to every row of docs.

    The prefix ends after the smaller and the middle after the larger of two drawn numbers of units, which depend on
    seed and id only, so that a repeated run, or a retried task, cuts alike. Forms: psm and spm, as in `output_of`,
    for `percent` of the documents, of which about spm_percent are spm; plain, where the output is the text, for the
    rest, for empty texts and for texts that hold a mark. A null text is empty, a null id hashes as no digits, equal
    rows are cut alike. Columns of docs with the names of the new ones are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n", "form", "prefix_chars", "middle_chars", "output")]
    h1, h2, h3, h4 = draws(F.col(doc_id), seed)
    # named apart from all columns of docs, for they may have any name
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept if c != text]).alias(f"{NEW}_row"),
        F.col(text).alias(f"{NEW}_text"),
        h1.alias(f"{NEW}_1"), h2.alias(f"{NEW}_2"),
        ((h3 % 100) < percent).alias(f"{NEW}_cut"), ((h4 % 100) < spm_percent).alias(f"{NEW}_spm"),
    )
    rows = with_cuts(rows, UNITS[units])
    body = F.coalesce(f"{NEW}_text", F.lit(""))
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains(body, F.lit(mark))
    plain = (body == "") | marked | ~F.col(f"{NEW}_cut")
    form = F.when(plain, "plain").when(F.col(f"{NEW}_spm"), "spm").otherwise("psm")
    low, high = (F.col(f"{NEW}_{k}").cast("int") for k in ("low", "high"))
    prefix, middle = F.substring(body, 1, low), F.substring(body, low + 1, high - low)
    suffix = F.substring(body, high + 1, F.length(body))
    return rows.select(
        *[F.col(f"{NEW}_text").alias(c) if c == text else F.col(f"{NEW}_row").getField(c).alias(c) for c in kept],
        F.col(f"{NEW}_n").alias("n"),
        form.alias("form"),
        F.when(~plain, low.cast("long")).alias("prefix_chars"),
        F.when(~plain, (high - low).cast("long")).alias("middle_chars"),
        output_of(form, body, prefix, middle, suffix).alias("output"),
    )


def output_of(form, text, prefix, middle, suffix):
    p, s, m = (F.lit(mark) for mark in MARKS)
    return (
        F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .when(form == "spm", F.concat(s, suffix, p, prefix, m, middle))
        .otherwise(text)
    )


def restored(form, output):
    """The text, from output and form alone. No cut part holds a mark, and marks cannot overlap, so that the output
    splits at its three marks only."""
    parts = F.split(output, "|".join(map(re.escape, MARKS)), -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )


def op13_columns(rows):
    """The digests of the registered query."""
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )
