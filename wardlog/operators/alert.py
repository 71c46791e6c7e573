"""Building rows of the alert table."""

from pyspark.sql import functions as F

from wardlog import fixed_values as fixed
from wardlog.functions.text import case
from wardlog.schema import ALERT_SCHEMA

# order in which detectors report alerts of one severity
DETECTORS = [
    "brute_force", "off_hours_login", "multi_privileged", "login_after_failures",
    "web_attacks", "rate_abuse", "exfiltration", "error_flood",
]
COLUMNS = [f.name for f in ALERT_SCHEMA]


def severity_rank(severity):
    return case([(severity == s, i) for i, s in enumerate(fixed.SEVERITIES)], 0)


def text(*parts):
    """Concatenation of columns and literal strings; null parts count as ''."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def fixed_decimals(value, places):
    """Text with a fixed number of decimals, ties to even."""
    return F.format_string(f"%.{places}f", F.bround(value, places))


def alert_rows(df, detector, alert_type, severity, title, description, evidence, actions,
               source_ip=None, target_account=None, order_line="order_line", created_at=None):
    """Project ``df`` to the alert table; ``evidence`` is a list of aliased columns."""
    out = df.withColumn("severity", severity)
    return out.select(
        "job_id",
        F.lit(alert_type).alias("alert_type"),
        "severity",
        severity_rank(F.col("severity")).alias("severity_rank"),
        F.lit(detector).alias("detector"),
        F.lit(DETECTORS.index(detector)).alias("detector_order"),
        F.col(order_line).cast("long").alias("order_line"),
        title.alias("title"),
        description.alias("description"),
        (source_ip if source_ip is not None else F.lit(None).cast("string")).alias("source_ip"),
        (target_account if target_account is not None else F.lit(None).cast("string")).alias("target_account"),
        F.to_json(F.struct(*evidence), {"ignoreNullFields": "false"}).alias("evidence"),
        F.array(*[F.lit(a) if isinstance(a, str) else a for a in actions]).alias("recommended_actions"),
        F.lit(False).alias("is_resolved"),
        (created_at if created_at is not None else F.current_timestamp()).alias("created_at"),
    )


def present(name):
    """A text field counts as absent when null or ''."""
    return F.col(name) != ""
