"""Lines of any mix of formats to entries."""

from pyspark.sql import functions as F

from wardlog.operators.line_format import normalize_as
from wardlog.operators.normalize_auth import AUTH, normalize_auth
from wardlog.operators.normalize_firewall import FIREWALL, normalize_firewall
from wardlog.operators.normalize_json import JSON, normalize_json
from wardlog.operators.normalize_waf import WAF
from wardlog.operators.normalize_web import ACCESS, ERROR, normalize_access, normalize_nginx_error

__all__ = [
    "LINE_FORMATS", "formats_present", "normalize", "normalize_access", "normalize_auth", "normalize_firewall",
    "normalize_json", "normalize_nginx_error", "parse_stats",
]

# Files whose formats may be broadcast; a row (path, job, format, eight places) takes a few hundred bytes.
BROADCAST_FILES = 500_000
# Extension point: a further format is one more LineFormat in this list.
LINE_FORMATS = [WAF, AUTH, ACCESS, ERROR, JSON, FIREWALL]


def formats_present(formats):
    """Names of the formats that occur: at most one per known format."""
    return sorted(r.format for r in formats.select("format").distinct().collect())


def normalize(lines, formats, assume_year=2026, small_formats=False, present=None):
    """Every line by the format of its file, in one scan of the lines.

    ``formats`` is the result of detect_format, one row per file. With
    ``small_formats`` the caller vouches that it fits a broadcast (the reader
    bounds the number of files before it says so); otherwise Spark chooses.
    ``present`` names the formats that occur, so that the plan holds no others.
    """
    used = [f for f in LINE_FORMATS if present is None or f.name in present]
    known = formats.select("job_id", "source_file", "format", "waf_columns")
    joined = lines.join(F.broadcast(known) if small_formats else known, ["job_id", "source_file"])
    return normalize_as(joined, used, assume_year)


def parse_stats(entries, lines):
    """Per job: non-blank lines, and entries that were recognised at all."""
    total = lines.groupBy("job_id").agg(F.count(F.lit(1)).alias("total_lines"))
    parsed = entries.groupBy("job_id").agg(
        F.count(F.when(F.col("event_type") != "unparsed", 1)).alias("parsed_lines")
    )
    return total.join(parsed, "job_id", "left").select(
        "job_id", "total_lines", F.coalesce("parsed_lines", F.lit(0)).alias("parsed_lines")
    )
