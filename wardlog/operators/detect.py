"""All detectors together."""

from functools import reduce

from pyspark.sql import functions as F

from wardlog import fixed_values as fixed
from wardlog.operators.detect_abuse import activity, detect_error_flood, detect_exfiltration, detect_rate_abuse
from wardlog.operators.detect_brute_force import detect_brute_force
from wardlog.operators.detect_login import (
    detect_login_after_failures, detect_multi_privileged, detect_off_hours_login,
)
from wardlog.operators.detect_web import detect_web_attacks
from wardlog.session import stored

# Extension point: name -> function of (entries, created_at=..., **thresholds) giving alerts.
DETECTOR_FUNCTIONS = {
    "brute_force": detect_brute_force,
    "off_hours_login": detect_off_hours_login,
    "multi_privileged": detect_multi_privileged,
    "login_after_failures": detect_login_after_failures,
    "web_attacks": detect_web_attacks,
    "rate_abuse": detect_rate_abuse,
    "exfiltration": detect_exfiltration,
    "error_flood": detect_error_flood,
}


def alert_order():
    """Sort columns: most severe first, then by detector, then by the line that raised the alert."""
    return [
        F.desc("severity_rank"), F.asc("detector_order"), F.asc("order_line"),
        F.asc("title"), F.asc("source_ip"), F.asc("description"),
    ]


# detectors that read logins only, and those that read the counts of activity()
LOGIN_DETECTORS = ["brute_force", "off_hours_login", "multi_privileged", "login_after_failures"]
ACTIVITY_DETECTORS = ["rate_abuse", "exfiltration", "error_flood"]
LOGIN_TYPES = sorted({
    *fixed.FAILED_LOGIN_TYPES, *fixed.SUCCESS_LOGIN_TYPES, *fixed.STREAK_FAILURE_TYPES, *fixed.PRIVILEGED_USE_TYPES,
})
LOGIN_COLUMNS = ["job_id", "source_ip", "username", "event_type", "event_time", "event_time_local", "line_number"]


def login_entries(entries):
    """The entries about logins, with the columns that their detectors read; written once."""
    return stored(entries.filter(F.col("event_type").isin(LOGIN_TYPES)).select(*LOGIN_COLUMNS), "logins")


def all_alerts(entries, thresholds=None, detectors=None, created_at=None):
    """Alerts of all (or the named) detectors, unsorted.

    ``thresholds`` maps a detector's name to its keyword arguments. Entries are
    read three times at most: for the logins, which are written apart, for counts
    by address, and for the web signatures. ``entries`` should be the stored table
    rather than a parse of raw lines.
    """
    thresholds, names = thresholds or {}, list(detectors or DETECTOR_FUNCTIONS)
    logins = login_entries(entries) if set(names) & set(LOGIN_DETECTORS) else None
    counts = activity(entries) if set(names) & set(ACTIVITY_DETECTORS) else None
    found = []
    for name in names:
        known = {"counts": counts} if name in ACTIVITY_DETECTORS else {}
        rows = logins if name in LOGIN_DETECTORS else entries
        found.append(DETECTOR_FUNCTIONS[name](rows, created_at=created_at, **known, **thresholds.get(name, {})))
    return reduce(lambda a, b: a.unionByName(b), found)


def run_all(entries, thresholds=None, detectors=None, created_at=None):
    """All alerts, most severe first."""
    return all_alerts(entries, thresholds, detectors, created_at).orderBy(*alert_order())
