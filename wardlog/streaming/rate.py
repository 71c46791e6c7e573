"""Request rates over a stream of entries."""

from pyspark.sql import functions as F


def stream_rate(entries, window="1 minute", slide=None, watermark=None, threshold=None):
    """Entries per job, address and event-time window; works on a stream or a table.

    Log files may arrive in any order, so by default every window stays open and
    each entry counts, however late; the state then holds one row per window of
    the result. A ``watermark`` bounds the state: windows further back are closed
    and entries for them no longer count (Spark reports their number in the
    query's progress as numRowsDroppedByWatermark).
    """
    found = entries.filter(F.col("source_ip") != "")
    if watermark is not None:
        found = found.withWatermark("event_time", watermark)
    counted = (
        found.groupBy(F.window("event_time", window, slide), "job_id", "source_ip")
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(
            "job_id", "source_ip", F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"), "requests",
        )
    )
    return counted if threshold is None else counted.filter(F.col("requests") >= threshold)
