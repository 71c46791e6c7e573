"""Counts in a sliding time window, without a hot key in one task."""

from pyspark.sql import Window
from pyspark.sql import functions as F

# A key's rows are cut into slices of this many windows; a row is copied to the
# next slice only if its window reaches into it (about one row in eight).
SLICE_WINDOWS = 8


def slice_of(us, length):
    """Number of the time slice holding ``us`` (floor division, also before 1970)."""
    return F.expr(f"({us} - pmod({us}, {length})) div {length}")


def sliding_counts(per_time, keys, window_us):
    """Add ``in_window``: rows of the same key in [us - window, us].

    ``per_time`` is pre-aggregated: one row per keys and ``us``, with ``n``. Every
    row becomes a rise by n at us and a fall by n just after us + window; the
    running sum of rises and falls is the number of rows in the window, in one
    ordered pass whatever the number of rows per window. The pass is partitioned
    by key and time slice, so one key's rows spread over many tasks.
    """
    length = window_us * SLICE_WINDOWS
    here, fall = slice_of("us", length), F.col("us") + window_us
    marker = lambda part, at, falls, delta, own: F.struct(
        part.alias("slice"), at.alias("at"), F.lit(falls).alias("falls"),
        delta.alias("delta"), F.lit(own).alias("own"),
    )
    n = F.col("n")
    own = marker(here, F.col("us"), 0, n, True)
    stays = fall < (here + 1) * length
    markers = F.when(stays, F.array(own, marker(here, fall, 1, -n, False))).otherwise(
        F.array(
            own,
            marker(here + 1, F.col("us"), 0, n, False),
            marker(here + 1, fall, 1, -n, False),
        )
    )
    order = (
        Window.partitionBy(*keys, "slice")
        .orderBy("at", "falls")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        per_time.select(*keys, F.explode(markers).alias("m"))
        .select(*keys, "m.*")
        .withColumn("in_window", F.sum("delta").over(order))
        .filter("own")
        .select(*keys, F.col("at").alias("us"), F.col("delta").alias("n"), "in_window")
    )


def window_slots(low, high, window_us):
    """The window-length slots that [low, high] touches, for an equi join on slots."""
    return F.sequence(
        F.expr(f"({low} - pmod({low}, {window_us})) div {window_us}"),
        F.expr(f"({high} - pmod({high}, {window_us})) div {window_us}"),
    )
