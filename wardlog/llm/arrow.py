"""Helpers for functions over Arrow batches."""

import pyarrow as pa

# ASCII: letters in lower case, digits as they are, all else blank; bytes of other characters stay
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
STEP_BYTES = 4 << 20
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(frame, function, schema):
    """mapInArrow, with at most BATCH_BYTES of rows in a batch; one long row may be more. The session's own bound is
    64 MB, which each worker and its executor hold several times over."""
    frame.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return frame.mapInArrow(function, schema)


def term_list(text):
    """Words of a text as bytes: runs of a-z, 0-9 and characters beyond ASCII, in ASCII lower case."""
    return text.encode().translate(TERM_BYTES).split()


def texts(batch, column="text"):
    """The strings of a column; a null is empty."""
    return [value or "" for value in batch.column(column).to_pylist()]


def in_steps(sized, limit=STEP_BYTES):
    """Lists of neighbouring items with about `limit` characters in all."""
    step, size = [], 0
    for item, length in sized:
        step.append(item)
        size += length
        if size >= limit:
            yield step
            step, size = [], 0
    if step:
        yield step


def with_columns(batch, keep, schema, **columns):
    """A batch of the kept columns and new ones, in the order and types of the schema."""
    arrays = [batch.column(f.name) if f.name in keep else pa.array(columns[f.name], f.type) for f in schema]
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)
