"""Text evidence per job for a later summary, and the job's risk."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlog import fixed_values as fixed
from wardlog.functions.text import case, spaced_json
from wardlog.functions.times import plain_text
from wardlog.operators.alert import text
from wardlog.operators.dashboard import facet_counts, most_frequent
from wardlog.operators.numbering import number_in_order

EVENT_TYPES = 15
NOTABLE = 30
EVIDENCE_CHARS = 500
MESSAGE_CHARS = 150
# alerts per evidence text; a job with more gets further parts instead of one endless text
ALERTS_PER_PART = 1000
# alerts are numbered in runs of this many log lines
RUN_LINES = 100_000


def event_type_distribution(entries, k=EVENT_TYPES):
    """The most frequent event types of every job."""
    value = F.coalesce(F.nullif("event_type", F.lit("")), F.lit("unknown"))
    counts = entries.groupBy("job_id", value.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return most_frequent(counts, ["job_id"], k).select(
        "job_id", "place", F.col("value").alias("event_type"), "count"
    )


def numbered_alerts(alerts):
    """Alerts with their ``number`` in the job's reporting order."""
    coarse = [
        ("_rank_down", -F.col("severity_rank")),
        ("_detector", F.col("detector_order")),
        ("_run", F.floor(F.col("order_line") / RUN_LINES)),
    ]
    return number_in_order(alerts, ["job_id"], coarse, ["order_line", "title", "source_ip", "description"], "number")


def alert_digest(alerts):
    """One text block per alert, numbered per job."""
    line = lambda label, value: F.when(value != "", F.concat(F.lit(f"\n  {label}: "), value))
    block = text(
        "\nAlert #", F.col("number"), ": [", F.upper("severity"), "] ", F.col("title"),
        "\n  Type: ", F.col("alert_type"), "\n  Description: ", F.col("description"),
        line("Source IP", F.col("source_ip")), line("Target Account", F.col("target_account")),
        line("Evidence", spaced_json(F.col("evidence"), EVIDENCE_CHARS)),
    )
    return numbered_alerts(alerts).select("job_id", "number", block.alias("text"))


def notable_sample(entries, k=NOTABLE):
    """The first entries of notable types, as text lines."""
    order = Window.partitionBy("job_id").orderBy("line_number")
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("N/A"))
    line = text(
        "  Line ", F.col("line_number"), ": [",
        F.coalesce(plain_text(F.col("event_time_local")), F.lit("N/A")), "] ", F.col("event_type"),
        " | IP: ", known("source_ip"), " | User: ", known("username"), " | ",
        F.substring("message", 1, MESSAGE_CHARS),
    )
    return (
        entries.filter(F.col("event_type").isin(fixed.NOTABLE_TYPES))
        .withColumn("number", F.row_number().over(order))
        .filter(F.col("number") <= k)
        .select("job_id", "number", "line_number", line.alias("text"))
    )


def evidence_lines(entries, alerts, log_types=None):
    """Text of every job's evidence in order: (job_id, part, section, position, text).

    ``log_types`` gives job_id and log_type. Nothing is gathered per job here;
    the alert section is the only one without a fixed bound and runs over parts.
    """
    at = lambda df, section, part, position, value: df.select(
        "job_id", part.cast("long").alias("part"), F.lit(section).alias("section"),
        position.cast("long").alias("position"), value.alias("text"),
    )
    zero = F.lit(0)
    totals = entries.groupBy("job_id").agg(F.count(F.lit(1)).alias("entries"))
    if log_types is None:
        totals = totals.withColumn("log_type", F.lit("unknown"))
    else:
        totals = totals.join(log_types.select("job_id", "log_type"), "job_id", "left")
    head = text(
        "Log Type: ", F.coalesce("log_type", F.lit("unknown")), "\nTotal Log Entries: ", F.col("entries"),
        "\n\nEvent Type Distribution:",
    )
    types = event_type_distribution(entries)
    facets = most_frequent(
        facet_counts(entries, ["source_ip", "username"]).filter("value <> ''"), ["job_id", "facet"], 10
    )
    counted = text("  ", F.col("value"), ": ", F.col("count"), " events")
    people = F.when(F.col("place") == 1, F.concat(F.lit("\nTop Usernames:\n"), counted)).otherwise(counted)
    digest = alert_digest(alerts)
    alert_part = F.floor((F.col("number") - 1) / ALERTS_PER_PART)
    alert_totals = alerts.groupBy("job_id").agg(F.count(F.lit(1)).alias("alerts"))
    last_part = F.floor((F.coalesce("alerts", F.lit(1)) - 1) / ALERTS_PER_PART)
    sample = notable_sample(entries)
    sample_totals = sample.groupBy("job_id").agg(F.count(F.lit(1)).alias("sampled"))
    sampled = sample.join(sample_totals, "job_id").join(alert_totals, "job_id", "left")
    titled = F.when(
        F.col("number") == 1,
        text("\n--- SAMPLE NOTABLE ENTRIES (", F.col("sampled"), ") ---\n", F.col("text")),
    ).otherwise(F.col("text"))
    parts = [
        at(totals, 0, zero, zero, head),
        at(types, 1, zero, F.col("place"), text("  ", F.col("event_type"), ": ", F.col("count"))),
        at(totals, 2, zero, zero, F.lit("\nTop Source IPs:")),
        at(facets.filter("facet = 'source_ip'"), 2, zero, F.col("place"), counted),
        at(facets.filter("facet = 'username'"), 3, zero, F.col("place"), people),
        at(alert_totals, 4, zero, zero, text("\n--- SECURITY ALERTS (", F.col("alerts"), ") ---")),
        at(digest, 4, alert_part, F.col("number"), F.col("text")),
        at(sampled, 5, last_part, F.col("number"), titled),
    ]
    lines = parts[0]
    for more in parts[1:]:
        lines = lines.unionByName(more)
    return lines


def evidence_pack(entries, alerts, log_types=None):
    """Evidence texts per job; the texts of a job's parts in order are the whole evidence."""
    ordered = F.array_sort(F.collect_list(F.struct("section", "position", "text")))
    return (
        evidence_lines(entries, alerts, log_types)
        .groupBy("job_id", "part")
        .agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))
    )


def job_risk(alerts, jobs):
    """The highest alert level of every job, info when it has no alert."""
    highest = alerts.groupBy("job_id").agg(F.max("severity_rank").alias("rank"))
    level = case([(F.col("rank") == i, s) for i, s in enumerate(fixed.SEVERITIES)], "info")
    return jobs.select("job_id").join(highest, "job_id", "left").select("job_id", level.alias("risk_level"))


def job_recommendations(alerts):
    """Recommended actions of a job's alerts in reporting order, one row each."""
    return numbered_alerts(alerts).select(
        "job_id", F.col("number").alias("alert_number"), F.posexplode("recommended_actions").alias("place", "action")
    ).select("job_id", "alert_number", (F.col("place") + 1).alias("action_number"), "action")
