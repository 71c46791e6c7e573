"""Request rates, transferred volume and error floods per address."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlog.functions.text import case
from wardlog.functions.times import logged_text, micros
from wardlog.operators.alert import alert_rows, fixed_decimals, present, text
from wardlog.operators.sliding import sliding_counts, window_slots
from wardlog.session import stored

KEYS = ["job_id", "source_ip"]
MIB = 1024 * 1024
# where a row without a line number stands among the lines: first
NO_LINE = -(2**63)

# Fixed values of the alert table: titles, descriptions, labels of the evidence, actions and the steps of the
# severity ladders below. They are written where they are used.


def activity(entries):
    """What the three detectors need of the entries, counted in one pass: one row per address, moment and wall clock (kind
    "time"), per address and endpoint with a response size ("volume") and per address and error status ("status").

    Rows: job_id, source_ip, kind, us, endpoint, status_code, n, bytes, line (the first), first (the same, NO_LINE if any
    has none) and the wall clock.
    """
    none = lambda kind: F.lit(None).cast(kind)
    part = lambda kind, us, endpoint, status, size: F.struct(
        F.lit(kind).alias("kind"), us.alias("us"), endpoint.alias("endpoint"), status.alias("status_code"), size.alias("size")
    )
    size = F.col("response_size")
    parts = F.array(
        F.when(F.col("event_time").isNotNull(), part("time", micros(F.col("event_time")), none("string"), none("int"), none("bigint"))),
        F.when(size != 0, part("volume", none("bigint"), F.nullif("endpoint", F.lit("")), none("int"), size)),
        F.when(F.col("status_code") >= 400, part("status", none("bigint"), none("string"), F.col("status_code"), none("bigint"))),
    )
    # parts are made in a projection, which is compiled; behind explode itself they are interpreted
    made = entries.filter(present("source_ip")).select(*KEYS, "line_number", "event_time_local", parts.alias("parts"))
    rows = made.select(*KEYS, "line_number", "event_time_local", F.explode_outer("parts").alias("p")).filter("p is not null")
    # a wall clock is a key of its own: plain numbers and times are counted in a hash table, a least pair needs a sort of all rows
    wall = F.when(F.col("p.kind") == "time", F.col("event_time_local")).alias("wall")
    counted = rows.select(*KEYS, "line_number", wall, "p.*").groupBy(
        *KEYS, "kind", "us", "endpoint", "status_code", "wall"
    ).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("line_number").alias("line"),
        F.min(F.coalesce("line_number", F.lit(NO_LINE))).alias("first"),
    )
    return stored(counted, "activity")


def _counts(entries, counts, kind):
    return (activity(entries) if counts is None else counts).filter(F.col("kind") == kind)


def peak_rates(entries, window_seconds=60, threshold=100, counts=None):
    """Per address: the most rows in any window ending at a row, the first such
    window (instants and wall clocks of its ends), and the number of rows; addresses
    below the threshold are left out. ``counts`` is the entries' activity, where it is known."""
    window_us = int(window_seconds * 1_000_000)
    per_time = _counts(entries, counts, "time").select(*KEYS, "us", "n", "line", "first", "wall")
    peaks = (
        sliding_counts(per_time.select(*KEYS, "us", "n"), KEYS, window_us)
        .filter(F.col("in_window") >= threshold)
        .groupBy(*KEYS)
        .agg(F.max(F.struct("in_window", (-F.col("us")).alias("earliest"))).alias("best"))
        .select(
            *KEYS, F.col("best.in_window").alias("peak"), (-F.col("best.earliest")).alias("end_us"),
            (-F.col("best.earliest") - window_us).alias("low_us"),
        )
    )
    # the window starts at the first row inside it; joined by slot, so that a hot
    # address does not meet its peak in one task
    slots = peaks.withColumn("slot", F.explode(window_slots("low_us", "end_us", window_us)))
    starts = (
        per_time.withColumn("slot", F.expr(f"(us - pmod(us, {window_us})) div {window_us}"))
        .join(slots.select(*KEYS, "slot", "low_us", "end_us"), [*KEYS, "slot"])
        .filter(F.col("us").between(F.col("low_us"), F.col("end_us")))
        .groupBy(*KEYS)
        .agg(
            F.min("us").alias("start_us"),
            F.min(F.struct("us", "first", "wall"))["wall"].alias("start_wall"),
            F.min(F.when(F.col("us") == F.col("end_us"), F.struct("first", "wall")))["wall"].alias("end_wall"),
        )
    )
    totals = per_time.groupBy(*KEYS).agg(F.sum("n").alias("total"), F.min("line").alias("order_line"))
    return peaks.join(starts, KEYS).join(totals, KEYS)


def detect_rate_abuse(entries, window_seconds=60, threshold=100, created_at=None, counts=None):
    """One alert per address whose peak rate reaches the threshold."""
    rows = peak_rates(entries, window_seconds, threshold, counts)
    ip, peak = F.col("source_ip"), F.col("peak")
    start, end = [logged_text(F.col(f"{at}_wall"), F.col(f"{at}_us")) for at in ("start", "end")]
    return alert_rows(
        rows,
        "rate_abuse",
        "api_abuse",
        severity=case([(peak >= 500, "critical"), (peak >= 300, "high")], "medium"),
        title=text("API Rate Abuse from ", ip),
        description=text(
            "IP ", ip, " made ", peak, f" requests per minute (threshold: {threshold}/min). Peak window: ",
            start, " to ", end, ".",
        ),
        evidence=[
            peak.alias("peak_rate_per_minute"), F.col("total").alias("total_requests"),
            start.alias("window_start"), end.alias("window_end"),
        ],
        actions=[
            text("Apply rate limiting to IP ", ip),
            "Implement API throttling at the gateway level",
            "Consider CAPTCHA or proof-of-work challenges",
            "Check if this is a DDoS pattern",
        ],
        source_ip=ip,
        created_at=created_at,
    )


def detect_exfiltration(entries, threshold_mb=50, top=5, created_at=None, counts=None):
    """One alert per address that fetched at least ``threshold_mb`` MiB, with its largest endpoints.

    Volumes come summed by endpoint; endpoints are only ranked for the addresses
    that reach the threshold.
    """
    sized = _counts(entries, counts, "volume")
    heavy = (
        sized.groupBy(*KEYS)
        .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("requests"), F.min("line").alias("order_line"))
        .filter(F.col("bytes") >= int(threshold_mb * MIB))
    )
    per_endpoint = (
        sized.filter("endpoint is not null")
        .select(*KEYS, "endpoint", F.col("bytes").alias("endpoint_bytes"), "line")
        .join(heavy.select(*KEYS), KEYS, "left_semi")
    )
    order = Window.partitionBy(*KEYS).orderBy(F.desc("endpoint_bytes"), "line")
    largest = (
        per_endpoint.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= top)
        .groupBy(*KEYS)
        .agg(
            F.array_sort(
                F.collect_list(F.struct("place", "endpoint", F.col("endpoint_bytes").alias("bytes")))
            ).alias("largest")
        )
    )
    rows = heavy.join(largest, KEYS, "left").withColumn("mb", F.col("bytes") / MIB)
    ip, mb = F.col("source_ip"), F.col("mb")
    largest = F.coalesce("largest", F.array().cast("array<struct<place:int,endpoint:string,bytes:bigint>>"))
    return alert_rows(
        rows,
        "exfiltration",
        "data_exfiltration",
        severity=case([(mb >= 500, "critical"), (mb >= 200, "high")], "medium"),
        title=text("Possible Data Exfiltration by ", ip),
        description=text(
            "IP ", ip, " downloaded ", fixed_decimals(mb, 1), " MB of data across ", F.col("requests"),
            " requests. Top endpoints: ", F.array_join(F.slice(largest["endpoint"], 1, 3), ", "),
        ),
        evidence=[
            F.col("bytes").alias("total_bytes"),
            F.bround(mb, 1).alias("total_mb"),
            F.col("requests").alias("request_count"),
            F.transform(largest, lambda e: F.struct(e["endpoint"], e["bytes"])).alias("top_endpoints"),
        ],
        actions=[
            text("Investigate what data IP ", ip, " accessed"),
            "Check for sensitive data in transferred content",
            "Review access controls on data endpoints",
            "Consider data loss prevention (DLP) controls",
        ],
        source_ip=ip,
        created_at=created_at,
    )


def detect_error_flood(entries, threshold=50, created_at=None, counts=None):
    """One alert per address with at least ``threshold`` 4xx responses."""
    rows = (
        _counts(entries, counts, "status")
        .groupBy(*KEYS)
        .agg(
            F.sum("n").alias("errors"),
            F.sum(F.when(F.col("status_code") < 500, F.col("n")).otherwise(0)).alias("client"),
            F.sum(F.when(F.col("status_code") >= 500, F.col("n")).otherwise(0)).alias("server"),
            F.map_from_entries(
                F.array_sort(F.collect_list(F.struct(F.col("status_code").cast("string"), "n")))
            ).alias("by_status"),
            F.min("line").alias("order_line"),
        )
        .filter((F.col("errors") >= threshold) & (F.col("client") >= threshold))
    )
    ip = F.col("source_ip")
    return alert_rows(
        rows,
        "error_flood",
        "api_abuse",
        severity=F.lit("medium"),
        title=text("Excessive Client Errors from ", ip),
        description=text(
            "IP ", ip, " generated ", F.col("client"), " client errors (4xx) and ", F.col("server"),
            " server errors (5xx). This may indicate directory brute-forcing or vulnerability scanning.",
        ),
        evidence=[
            F.col("client").alias("4xx_count"), F.col("server").alias("5xx_count"),
            F.col("by_status").alias("status_distribution"), F.col("errors").alias("total_errors"),
        ],
        actions=[
            text("Block or rate-limit IP ", ip),
            "Review error patterns for reconnaissance activity",
            "Ensure sensitive paths return generic responses",
        ],
        source_ip=ip,
        created_at=created_at,
    )
