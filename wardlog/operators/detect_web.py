"""Attack signatures in requests."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlog import fixed_values as fixed
from wardlog.functions.text import case, contains_any
from wardlog.operators.alert import alert_rows, text

SAMPLE_LINES = 10
SAMPLE_ENDPOINTS = 5
# partial results of a group are merged this many at a time
FAN_IN = 1000

# Fixed values of the alert table: titles, descriptions, labels of the evidence, actions and the steps of the
# severity ladders below. They are written where they are used.


def signature(category):
    """One alternation for all patterns of a category."""
    return "|".join(
        f"(?{'i' if any_case else ''}dU:{pattern})" for pattern, any_case in fixed.ATTACK_SIGNATURES[category]
    )


def attack_target():
    """The text that is searched: endpoint, else message, else the line."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in ("endpoint", "message", "raw_line")])


def match_attack_categories(entries):
    """One row per entry and category whose signatures it matches, with ``category``.

    Only texts that hold one of a category's marks are searched for its signatures, as the marks are told much faster.
    A letter of another alphabet can count as one of a signature (a long s as an s), so texts with characters of several
    bytes are searched in any case.
    """
    hits = F.array(*[
        F.when((contains_any(F.col("lowered"), marks) | F.col("beyond_ascii")) & F.col("target").rlike(signature(c)), c)
        for c, marks in fixed.ATTACK_MARKS.items()
    ])
    # hits are found in a projection, which is compiled; behind explode itself they are interpreted
    return (
        entries.withColumn("target", attack_target())
        .withColumns({"lowered": F.lower("target"), "beyond_ascii": F.octet_length("target") != F.length("target")})
        .withColumn("hits", hits)
        .withColumn("category", F.explode_outer("hits"))
        .filter("category is not null")
        .drop("target", "lowered", "beyond_ascii", "hits")
    )


def detect_web_attacks(entries, created_at=None):
    """One alert per category and address."""
    ip = F.coalesce(F.nullif("source_ip", F.lit("")), F.lit("unknown"))
    sample = F.coalesce(
        F.nullif("endpoint", F.lit("")), F.nullif(F.substring("message", 1, 100), F.lit("")),
        F.substring("raw_line", 1, 100),
    )
    keys = ["job_id", "category", "source_ip"]
    hits = match_attack_categories(entries).select(
        "job_id", "category", ip.alias("source_ip"), "line_number", sample.alias("sample"),
        F.spark_partition_id().alias("part"),
    )
    # Signatures are costly, so entries are read once. The rows of a group that
    # come from one scan task are counted and ranked on their own, however hot the
    # group is; counts and first rows are then merged in two steps. The result does
    # not depend on which task read a row.
    part = Window.partitionBy(*keys, "part")
    first = (
        hits.withColumn("rank", F.row_number().over(part.orderBy("line_number")))
        .withColumn("in_part", F.count(F.lit(1)).over(part))
        .filter(F.col("rank") <= SAMPLE_LINES)
    )
    earliest = lambda rows: F.slice(F.array_sort(rows), 1, SAMPLE_LINES).alias("firsts")
    parts = first.groupBy(*keys, "part").agg(
        F.max("in_part").alias("count"), earliest(F.collect_list(F.struct("line_number", "sample")))
    )
    merge = lambda partial, *by: partial.groupBy(*by).agg(
        F.sum("count").alias("count"), earliest(F.flatten(F.collect_list("firsts")))
    )
    bundled = merge(parts.withColumn("part", F.floor(F.col("part") / FAN_IN)), *keys, "part")
    rows = merge(bundled, *keys).withColumns(
        {
            "order_line": F.get("firsts", F.lit(0))["line_number"],
            "sample_endpoints": F.array_sort(
                F.array_distinct(F.slice(F.col("firsts.sample"), 1, SAMPLE_ENDPOINTS))
            ),
            "sample_lines": F.col("firsts.line_number"),
        }
    )
    count, category, ip = F.col("count"), F.col("category"), F.col("source_ip")
    scan = category == fixed.SCANNING
    return alert_rows(
        rows,
        "web_attacks",
        "web_attack",
        severity=case(
            [
                (scan & (count > 10), "medium"), (scan, "low"),
                (count >= 20, "critical"), (count >= 10, "high"), (count >= 3, "medium"),
            ],
            "low",
        ),
        title=text(category, " Attempt from ", ip),
        description=text(
            "Detected ", count, " ", F.lower(category), " attempt(s) from IP ", ip, ". Sample targets: ",
            F.array_join(F.slice("sample_endpoints", 1, 3), ", "),
        ),
        evidence=[
            category.alias("attack_type"), count.alias("attempt_count"), ip.alias("source_ip"),
            F.col("sample_endpoints"), F.col("sample_lines"),
        ],
        actions=[
            text("Block IP ", ip, " at WAF/firewall level"),
            text("Review all requests from ", ip, " for successful exploitation"),
            "Check application logs for signs of data breach",
            text("Update WAF rules to block ", F.lower(category), " patterns"),
            "Ensure input validation and parameterized queries are in place",
        ],
        source_ip=ip,
        created_at=created_at,
    )
