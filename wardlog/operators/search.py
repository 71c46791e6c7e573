"""Entry search, alert lists and job lists."""

from pyspark.sql import functions as F

from wardlog.operators.detect import alert_order

# pages within so many rows are taken from the top; deeper ones are looked up by counts of so many ranges
DEEP_ROWS = 10_000
RANGES = 1000


def matching_entries(entries, event_type=None, source_ip=None, username=None, search=None, job_id=None):
    """Entries meeting all given conditions; ``search`` matches the message in any
    case, its % and _ acting as wildcards."""
    for column, wanted in (
        ("job_id", job_id), ("event_type", event_type), ("source_ip", source_ip), ("username", username),
    ):
        if wanted:
            entries = entries.filter(F.col(column) == wanted)
    if search:
        entries = entries.filter(F.col("message").ilike(f"%{search}%"))
    return entries


def search_entries(entries, page=1, page_size=50, deep_rows=DEEP_ROWS, **conditions):
    """One page of the matching entries in line order.

    A page among the first ``deep_rows`` rows is taken from the top. For a deeper one, matching entries are counted by
    ranges of lines until the range that holds the page has at most that many rows; only that range is sorted.
    """
    found, offset = matching_entries(entries, **conditions), (page - 1) * page_size
    if offset + page_size > deep_rows:
        found, offset = range_of_page(found, offset, page_size, deep_rows)
    return found.orderBy("line_number", "job_id").offset(offset).limit(page_size)


def range_of_page(found, offset, size, most):
    """The rows of a range of lines that holds the page, and the offset left within it. The driver sees RANGES counts
    at a time."""
    line = F.col("line_number")
    low, high = found.agg(F.min(line), F.max(line)).first()
    rows = None
    while low is not None and low < high and (rows is None or rows > most):
        width = -(-(high - low + 1) // RANGES)
        inside = found.filter(line.between(low, high))
        part = F.expr(f"(line_number - {low}) div {width}")
        counts = sorted(map(tuple, inside.groupBy(part.alias("part")).agg(F.count(F.lit(1))).collect()))
        passed, first, last, rows = 0, None, None, 0
        for number, count in counts:
            if passed + count > offset and first is None:
                first, before = number, passed
            if first is not None:
                last, rows = number, rows + count
            passed += count
            if passed >= offset + size:
                break
        if first is None:
            return found.limit(0), 0
        low, high, offset = low + first * width, min(high, low + (last + 1) * width - 1), offset - before
        if width == 1:
            break
    return (found if low is None else found.filter(line.between(low, high))), offset


def search_count(entries, **conditions):
    """Number of matching entries."""
    return matching_entries(entries, **conditions).agg(F.count(F.lit(1)).alias("total"))


def scope_to_owner(jobs, user, is_admin=False):
    """Jobs a user may see: all for an admin, else their own."""
    return jobs if is_admin else jobs.filter(F.col("created_by_user_id") == user)


def scoped_alerts(alerts, jobs, job_id=None, severity=None, owner=None):
    """Alerts of known jobs, optionally of one job, level or owner, unsorted."""
    if owner is not None:
        jobs = scope_to_owner(jobs, owner)
    if job_id:
        jobs, alerts = [d.filter(F.col("job_id") == job_id) for d in (jobs, alerts)]
    if severity:
        alerts = alerts.filter(F.col("severity") == severity)
    return alerts.join(jobs.select("job_id"), "job_id")


def list_alerts(alerts, jobs, job_id=None, severity=None, owner=None):
    """Scoped alerts, newest first."""
    found = scoped_alerts(alerts, jobs, job_id, severity, owner)
    return found.orderBy(F.desc("created_at"), "job_id", *alert_order())


def count_alerts(alerts, jobs, job_id=None, severity=None, owner=None):
    """Number of the alerts that list_alerts gives."""
    return scoped_alerts(alerts, jobs, job_id, severity, owner).agg(F.count(F.lit(1)).alias("total"))


def filter_alerts(alerts, text):
    """Alerts whose level is ``text`` or whose type contains it."""
    return alerts.filter((F.col("severity") == text) | F.contains("alert_type", F.lit(text)))


def job_summary(jobs, alerts):
    """Jobs with the number of their alerts."""
    counts = alerts.groupBy("job_id").agg(F.count(F.lit(1)).alias("alert_count"))
    return jobs.join(counts, "job_id", "left").withColumn("alert_count", F.coalesce("alert_count", F.lit(0)))


def count_jobs(jobs, owner=None):
    """Number of the jobs that list_jobs pages through."""
    found = jobs if owner is None else scope_to_owner(jobs, owner)
    return found.agg(F.count(F.lit(1)).alias("total"))


def list_jobs(jobs, page=1, page_size=20, owner=None):
    """One page of jobs, newest first."""
    if owner is not None:
        jobs = scope_to_owner(jobs, owner)
    return jobs.orderBy(F.desc("created_at"), "job_id").offset((page - 1) * page_size).limit(page_size)
