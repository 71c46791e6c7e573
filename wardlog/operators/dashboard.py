"""Dashboard aggregates, for any number of jobs at once."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlog import fixed_values as fixed
from wardlog.functions.text import case

WAF_LABELS = {"waf_block": "BLOCK", "waf_allow": "ALLOW", "waf_count": "COUNT"}
RULE_LABEL = 120


def _is(*types):
    return F.col("event_type").isin(*types)


def _rule():
    return F.nullif(F.element_at("extra_fields", "terminating_rule"), F.lit(""))


# facet -> (value, rows that count, how many are listed)
FACETS = {
    "source_ip": (lambda: F.col("source_ip"), lambda: F.lit(True), 10),
    "endpoint": (lambda: F.col("endpoint"), lambda: F.lit(True), 10),
    "username": (lambda: F.col("username"), lambda: F.lit(True), 10),
    "blocked_ip": (lambda: F.col("source_ip"), lambda: _is("waf_block"), 10),
    "blocked_endpoint": (lambda: F.col("endpoint"), lambda: _is("waf_block"), 10),
    "rule": (_rule, lambda: _is(*fixed.WAF_TYPES), 15),
}


def facet_counts(entries, facets):
    """Rows per (job_id, facet, value); several facets are counted in one scan."""
    if len(facets) == 1:
        value, counted, _ = FACETS[facets[0]]
        rows = entries.filter(counted()).select(
            "job_id", F.lit(facets[0]).alias("facet"), value().alias("value")
        ).filter("value is not null")
    else:
        pairs = [
            F.when(
                FACETS[f][1]() & FACETS[f][0]().isNotNull(),
                F.struct(F.lit(f).alias("facet"), FACETS[f][0]().alias("value")),
            )
            for f in facets
        ]
        # pairs are made in a projection, which is compiled; behind explode itself they are interpreted
        made = entries.select("job_id", F.array(*pairs).alias("pairs"))
        rows = made.select("job_id", F.explode_outer("pairs").alias("p")).filter("p is not null").select(
            "job_id", "p.facet", "p.value"
        )
    return rows.groupBy("job_id", "facet", "value").agg(F.count(F.lit(1)).alias("count"))


def most_frequent(counts, keys, k):
    """The ``k`` most frequent values per keys; equal counts by value."""
    order = Window.partitionBy(*keys).orderBy(F.desc("count"), "value")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _top(entries, facet, name, k):
    k = FACETS[facet][2] if k is None else k
    return most_frequent(facet_counts(entries, [facet]), ["job_id"], k).select(
        "job_id", F.col("value").alias(name), "count"
    )


def top_ips(entries, k=None):
    return _top(entries, "source_ip", "ip", k)


def top_endpoints(entries, k=None):
    return _top(entries, "endpoint", "endpoint", k)


def top_users(entries, k=None):
    return _top(entries, "username", "username", k)


def top_blocked_ips(entries, k=None):
    return _top(entries, "blocked_ip", "ip", k)


def top_blocked_endpoints(entries, k=None):
    return _top(entries, "blocked_endpoint", "endpoint", k)


def top_rules(entries, k=None):
    """Terminating rules; the label is cut to its end after grouping."""
    return _top(entries, "rule", "rule", k).withColumn("rule", F.right(F.col("rule"), F.lit(RULE_LABEL)))


def percent(part, whole):
    """Percentage with two decimals, ties to even; 0 for an empty whole."""
    return F.when(whole > 0, F.bround(part / whole * 100, 2)).otherwise(F.lit(0.0))


def _counters():
    count_if = lambda condition: F.count(F.when(condition, 1))
    return [
        F.count(F.lit(1)).alias("total_events"),
        count_if(_is("login_failed")).alias("failed_logins"),
        count_if(_is("login_success")).alias("successful_logins"),
        count_if(F.col("status_code") >= 400).alias("error_events"),
        count_if(_is(*fixed.WAF_TYPES)).alias("waf_events"),
    ]


def dash_scalars(entries):
    """One row per job: totals, logins, error rate, distinct addresses."""
    distinct = (
        entries.filter("source_ip is not null").select("job_id", "source_ip").distinct()
        .groupBy("job_id").agg(F.count(F.lit(1)).alias("unique_ips"))
    )
    return entries.groupBy("job_id").agg(*_counters()).join(distinct, "job_id", "left").select(
        "job_id", "total_events", F.coalesce("unique_ips", F.lit(0)).alias("unique_ips"),
        "failed_logins", "successful_logins",
        percent(F.col("error_events"), F.col("total_events")).alias("error_rate"),
        (F.col("waf_events") > 0).alias("waf_has_data"),
    )


def hourly(entries):
    """Per job and hour of day: all entries, and web-firewall entries by action."""
    count_if = lambda condition: F.count(F.when(condition, 1))
    return entries.groupBy("job_id", F.hour("event_time_local").alias("hour")).agg(
        F.count(F.lit(1)).alias("count"),
        count_if(_is(*fixed.WAF_TYPES)).alias("total"),
        count_if(_is("waf_block")).alias("blocked"),
        count_if(_is("waf_allow")).alias("allowed"),
        count_if(_is("waf_count")).alias("counted"),
    )


def events_by_hour(entries):
    """Entries per hour of day; only hours that occur."""
    return (
        entries.filter("event_time_local is not null")
        .groupBy("job_id", F.hour("event_time_local").alias("hour"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def waf_actions(entries):
    """Web-firewall entries by action label."""
    label = case([(F.col("event_type") == t, name) for t, name in WAF_LABELS.items()])
    return (
        entries.filter(_is(*fixed.WAF_TYPES))
        .groupBy("job_id", label.alias("action"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def _all_hours():
    """One array of 24 structs per job; hours without entries count 0."""
    found = F.collect_list(
        F.when(
            F.col("hour").isNotNull(),
            F.struct("hour", F.struct("total", "blocked", "allowed", "counted").alias("v")),
        )
    )
    zero = lambda v, name: F.coalesce(v[name], F.lit(0)).alias(name)
    return F.transform(
        F.sequence(F.lit(0), F.lit(23)),
        lambda h: F.struct(
            h.alias("hour"), *[zero(F.element_at(F.map_from_entries(F.col("found")), h), n)
                               for n in ("total", "blocked", "allowed", "counted")]
        ),
    ), found


def waf_by_hour(entries):
    """Web-firewall entries for each of the 24 hours of every job."""
    hours, found = _all_hours()
    return (
        hourly(entries).groupBy("job_id").agg(found.alias("found"))
        .select("job_id", F.explode(hours).alias("h")).select("job_id", "h.*")
    )


def alerts_by_severity(alerts):
    return alerts.groupBy("job_id", "severity").agg(F.count(F.lit(1)).alias("count"))


def alerts_by_type(alerts):
    return alerts.groupBy("job_id", "alert_type").agg(F.count(F.lit(1)).alias("count"))


def severity_distribution(alerts, jobs):
    """Alerts of every level for every job, zero included."""
    levels = [F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in fixed.SEVERITIES]
    counted = alerts.groupBy("job_id").agg(*levels)
    pairs = F.array(
        *[
            F.struct(F.lit(s).alias("severity"), F.coalesce(F.col(s), F.lit(0)).alias("count"))
            for s in fixed.SEVERITIES
        ]
    )
    return (
        jobs.select("job_id").distinct().join(counted, "job_id", "left")
        .select("job_id", F.explode(pairs).alias("p")).select("job_id", "p.*")
    )


def _listed(facet, name):
    """The places of one facet as an ordered array of (name, count)."""
    value = F.right(F.col("value"), F.lit(RULE_LABEL)) if facet == "rule" else F.col("value")
    placed = F.array_sort(
        F.collect_list(F.when(F.col("facet") == facet, F.struct("place", value.alias(name), "count")))
    )
    return F.transform(placed, lambda p: F.struct(p[name], p["count"]))


HOUR_COUNTS = ["count", "total", "blocked", "allowed", "counted"]
COUNTERS = ["total_events", "failed_logins", "successful_logins", "error_events", "waf_events"]


def counted_hours(entries):
    """Per job and hour of day (null without a time): all counters of the dashboard; sums of them merge."""
    count_if = lambda condition: F.count(F.when(condition, 1))
    return entries.groupBy("job_id", F.hour("event_time_local").alias("hour")).agg(
        *_counters(),
        F.count(F.lit(1)).alias("count"),
        count_if(_is(*fixed.WAF_TYPES)).alias("total"),
        count_if(_is("waf_block")).alias("blocked"),
        count_if(_is("waf_allow")).alias("allowed"),
        count_if(_is("waf_count")).alias("counted"),
    )


def dashboard(entries, alerts):
    """One wide row per job with every metric.

    Entries are read twice whatever the number of metrics: hours and facets; lists
    are bounded by their top-k, 24 hours, levels or types.
    """
    return dashboard_of_counts(counted_hours(entries), facet_counts(entries, list(FACETS)), alerts)


def dashboard_of_counts(hours_of_jobs, counts, alerts):
    """The dashboard from counted_hours, facet_counts over all FACETS, and the alerts."""
    empty = lambda kind: F.array().cast(kind)
    counters = hours_of_jobs.groupBy("job_id").agg(*[F.sum(c).alias(c) for c in COUNTERS])
    hours, found = _all_hours()
    by_hour = hours_of_jobs.groupBy("job_id").agg(
        found.alias("found"),
        F.array_sort(
            F.collect_list(F.when(F.col("hour").isNotNull(), F.struct("hour", "count")))
        ).alias("events_by_hour"),
        *[F.sum(n).alias(n) for n in ("blocked", "allowed", "counted")],
    )
    action = lambda n, label: F.when(
        F.col(n) > 0, F.struct((-F.col(n)).alias("less"), F.lit(label).alias("action"), F.col(n).alias("count"))
    )
    by_hour = by_hour.select(
        "job_id",
        "events_by_hour",
        hours.alias("waf_events_by_hour"),
        F.transform(
            F.array_sort(
                F.array_compact(
                    F.array(action("blocked", "BLOCK"), action("allowed", "ALLOW"), action("counted", "COUNT"))
                )
            ),
            lambda a: F.struct(a["action"], a["count"]),
        ).alias("waf_action_counts"),
    )
    limit = case([(F.col("facet") == f, FACETS[f][2]) for f in FACETS])
    most = max(k for _, _, k in FACETS.values())
    lists = (
        most_frequent(counts, ["job_id", "facet"], most)
        .filter(F.col("place") <= limit)
        .groupBy("job_id")
        .agg(
            _listed("source_ip", "ip").alias("top_source_ips"),
            _listed("endpoint", "endpoint").alias("top_endpoints"),
            _listed("username", "username").alias("top_usernames"),
            _listed("blocked_ip", "ip").alias("top_blocked_ips"),
            _listed("blocked_endpoint", "endpoint").alias("top_blocked_endpoints"),
            _listed("rule", "rule").alias("top_terminating_rules"),
        )
    )
    distinct = counts.filter("facet = 'source_ip'").groupBy("job_id").agg(F.count(F.lit(1)).alias("ips"))
    level = lambda s: F.sum(F.when(F.col("severity") == s, F.col("count")).otherwise(0))
    raised = (
        alerts.groupBy("job_id", "severity", "alert_type").agg(F.count(F.lit(1)).alias("count"))
        .groupBy("job_id", "alert_type")
        .agg(F.sum("count").alias("count"), *[level(s).alias(s) for s in fixed.SEVERITIES])
        .groupBy("job_id")
        .agg(
            F.sum("count").alias("alerts"),
            F.array_sort(F.collect_list(F.struct(F.col("alert_type").alias("type"), "count"))).alias("by_type"),
            *[F.sum(s).alias(s) for s in fixed.SEVERITIES],
        )
    )
    number = lambda name: F.coalesce(F.col(name), F.lit(0))
    wide = (
        counters.join(by_hour, "job_id", "left").join(lists, "job_id", "left")
        .join(distinct, "job_id", "left").join(raised, "job_id", "left")
    )
    top_lists = [
        ("top_source_ips", "ip"), ("top_endpoints", "endpoint"), ("top_usernames", "username"),
        ("top_blocked_ips", "ip"), ("top_blocked_endpoints", "endpoint"), ("top_terminating_rules", "rule"),
    ]
    return wide.select(
        "job_id",
        "total_events",
        number("alerts").alias("total_alerts"),
        *[number(s).alias(f"{s}_alerts") for s in reversed(fixed.SEVERITIES) if s != "info"],
        number("ips").alias("unique_ips"),
        "failed_logins",
        "successful_logins",
        percent(F.col("error_events"), F.col("total_events")).alias("error_rate"),
        *[
            F.coalesce(F.col(n), empty(f"array<struct<{v}:string,count:bigint>>")).alias(n)
            for n, v in top_lists
        ],
        "events_by_hour",
        F.coalesce(F.col("by_type"), empty("array<struct<type:string,count:bigint>>")).alias("alerts_by_type"),
        F.array(
            *[F.struct(F.lit(s).alias("severity"), number(s).alias("count")) for s in fixed.SEVERITIES]
        ).alias("severity_distribution"),
        (F.col("waf_events") > 0).alias("waf_has_data"),
        "waf_action_counts",
        "waf_events_by_hour",
    )
