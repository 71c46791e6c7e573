"""Which format a file has, from its first lines."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlog import fixed_values as fixed
from wardlog.functions.text import case, contains_any
from wardlog.operators.normalize_json import is_json
from wardlog.operators.normalize_waf import column_places

SAMPLE_LINES = 100


def sample_lines(lines, n=SAMPLE_LINES):
    """The non-blank ones among the first ``n`` physical lines of every file."""
    return lines.filter(F.col("line_number") <= n)


def format_scores(lines):
    """One row per file with the score of every format, from 0 to 1."""
    line = F.col("raw_line")
    share = lambda condition: F.avg(F.coalesce(condition, F.lit(False)).cast("int"))
    seen = sample_lines(lines).groupBy("job_id", "source_file").agg(
        F.min_by("raw_line", "line_number").alias("first_line"),
        share(line.rlike(fixed.AUTH_LINE)).alias("auth_share"),
        F.max(contains_any(line, fixed.AUTH_KEYWORDS)).alias("auth_named"),
        share(line.rlike(fixed.ACCESS_LINE)).alias(fixed.ACCESS),
        share(line.rlike(fixed.ERROR_LINE)).alias(fixed.ERROR),
        share(is_json(line)).alias(fixed.JSON),
        F.least(F.lit(0.95), share(contains_any(line, fixed.FIREWALL_KEYWORDS))).alias(fixed.FIREWALL),
    )
    head = F.lower(F.col("first_line"))
    top = F.substring(head, 1, 3000)
    is_waf = F.startswith(head, F.lit("timestamp,")) & reduce(
        lambda a, b: a & b, [F.contains(top, F.lit(w)) for w in ("clientip", "uri", "httpmethod")]
    )
    auth = F.col("auth_share")
    return seen.select(
        "job_id",
        "source_file",
        "first_line",
        F.when(is_waf, 0.98).otherwise(0.0).alias(fixed.WAF),
        F.when(F.col("auth_named") & (auth > 0.3), F.least(F.lit(0.95), auth + 0.2))
        .otherwise(auth * 0.7)
        .alias(fixed.AUTH),
        *[F.col(f) for f in (fixed.ACCESS, fixed.ERROR, fixed.JSON, fixed.FIREWALL)],
    )


def hinted_format(hint):
    """Format for a hint word in any case, null when there is none or it is unknown; ``hint`` is a
    word for all files, or a column over job_id and source_file that gives one per file."""
    word = F.lower(hint if isinstance(hint, Column) else F.lit(hint).cast("string"))
    return case([(word == w, f) for w, f in fixed.FORMAT_HINTS.items()])


def detect_format(lines, hint=None):
    """One row per file: (job_id, source_file, format, score, waf_columns); see hinted_format for ``hint``.

    The highest score wins, ties go to the earlier format, no score at all means
    JSON. ``waf_columns`` says where a CSV export has its columns, else null.
    """
    scores = format_scores(lines)
    ranked = [
        F.struct(F.col(f).alias("score"), F.lit(-i).alias("place"), F.lit(f).alias("format"))
        for i, f in enumerate(fixed.FORMAT_ORDER)
    ]
    forced = F.col("forced")
    best = case([(forced == f, r) for f, r in zip(fixed.FORMAT_ORDER, ranked)], F.greatest(*ranked))
    chosen = scores.withColumn("forced", hinted_format(hint)).withColumn("best", best).withColumn(
        "format", F.coalesce(forced, case([(F.col("best.score") > 0, F.col("best.format"))], fixed.JSON))
    )
    return chosen.select(
        "job_id",
        "source_file",
        "format",
        F.col("best.score").alias("score"),
        F.when(F.col("format") == fixed.WAF, column_places(F.col("first_line"))).alias("waf_columns"),
    )
