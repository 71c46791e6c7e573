"""Notable entries and alerts on one time line per job."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlog import fixed_values as fixed
from wardlog.functions.text import case

COLUMNS = ["job_id", "timestamp", "event_type", "source_ip", "username", "description", "severity"]


def timeline(entries, alerts, limit=200):
    """The first ``limit`` events of every job, with ``total`` before that cut.

    Of the entries only the first ``limit`` notable ones are considered; all
    alerts are. Entries come before alerts of the same time. The ranks are
    bounded, so tasks drop later rows before any shuffle.
    """
    notable = entries.filter(
        F.col("event_type").isin(fixed.TIMELINE_TYPES) & F.col("event_time").isNotNull()
    )
    level = case([(F.col("event_type") == t, s) for t, s in fixed.TIMELINE_SEVERITY.items()])
    first = Window.partitionBy("job_id").orderBy("event_time", "line_number")
    from_entries = (
        notable.withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= limit)
        .select(
            "job_id",
            F.col("event_time").alias("timestamp"),
            "event_type",
            "source_ip",
            "username",
            F.coalesce(F.nullif("message", F.lit("")), F.concat("event_type", F.lit(" event"))).alias("description"),
            level.alias("severity"),
            F.lit(0).alias("origin"),
            F.lit(0).alias("rank_down"),
            F.lit(0).alias("detector_order"),
            F.col("line_number").alias("order_line"),
        )
    )
    from_alerts = alerts.select(
        "job_id",
        F.col("created_at").alias("timestamp"),
        F.concat(F.lit("alert_"), "alert_type").alias("event_type"),
        "source_ip",
        F.col("target_account").alias("username"),
        F.col("title").alias("description"),
        "severity",
        F.lit(1).alias("origin"),
        (-F.col("severity_rank")).alias("rank_down"),
        "detector_order",
        "order_line",
    )
    totals = (
        notable.groupBy("job_id").agg(F.least(F.count(F.lit(1)), F.lit(limit)).alias("n"))
        .unionByName(alerts.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")))
        .groupBy("job_id").agg(F.sum("n").alias("total"))
    )
    order = Window.partitionBy("job_id").orderBy(
        "timestamp", "origin", "rank_down", "detector_order", "order_line", "description", "source_ip"
    )
    return (
        from_entries.unionByName(from_alerts)
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= limit)
        .join(totals, "job_id")
        .select(*COLUMNS, "place", "total")
        .orderBy("job_id", "place")
    )


def timeline_types(events):
    """Event types on a time line, sorted."""
    return events.select("event_type").distinct().orderBy("event_type")


def filter_timeline(events, event_type):
    """Events of one type."""
    return events.filter(F.col("event_type") == event_type)
