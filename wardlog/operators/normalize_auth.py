"""Syslog-style login logs."""

from pyspark.sql import functions as F

from wardlog import fixed_values as fixed
from wardlog.functions.text import capture, case, extract, matched, strip
from wardlog.functions.times import as_instant, syslog_clock
from wardlog.operators.line_format import LineFormat, normalize_as, strings

# event type, text every matching message holds, pattern, group of user, group of ip.
# In order: the first match names the event. Looking for the fixed text first
# spares most lines most patterns.
MESSAGES = [
    ("login_failed", "Failed password for ", fixed.FAILED_PASSWORD, 1, 2),
    ("login_success", "Accepted p", fixed.ACCEPTED_LOGIN, 1, 2),
    ("invalid_user", "Invalid user ", fixed.INVALID_USER, 1, 2),
    ("session_opened", "session opened for user ", fixed.SESSION_OPENED, 1, None),
    ("session_closed", "session closed for user ", fixed.SESSION_CLOSED, 1, None),
    ("sudo_command", "COMMAND=", fixed.SUDO_COMMAND, 1, None),
    ("connection_closed", "Connection closed by ", fixed.CONNECTION_CLOSED, 1, 2),
]


def _header(assume_year):
    return {"auth_part": capture(F.col("raw_line"), fixed.AUTH_LINE, 9)}


def _event(assume_year):
    message = F.get("auth_part", F.lit(8))
    found = case(
        [(F.contains(message, F.lit(hint)) & message.rlike(p), kind) for kind, hint, p, _, _ in MESSAGES]
        + [(F.contains(F.lower(message), F.lit("disconnect")), "disconnected")],
        "auth_other",
    )
    return {
        "auth_message": message,
        "auth_event": F.when(matched("auth_part"), found).otherwise("unknown"),
        "auth_time": syslog_clock(F.col("auth_part"), assume_year),
    }


def _fields(assume_year):
    message, event = F.col("auth_message"), F.col("auth_event")
    header = strings(hostname=F.get("auth_part", F.lit(5)), service=F.get("auth_part", F.lit(6)))
    command = strip(F.regexp_extract(message, fixed.SUDO_COMMAND, 2))
    return {
        "event_time": as_instant(F.col("auth_time")),
        "event_time_local": F.col("auth_time"),
        "username": case([(event == k, extract(message, p, u)) for k, _, p, u, _ in MESSAGES]),
        "source_ip": case([(event == k, extract(message, p, i)) for k, _, p, _, i in MESSAGES if i]),
        "event_type": event,
        "message": F.coalesce(message, F.col("raw_line")),
        "extra_fields": case(
            [
                (event == "unknown", F.lit(None)),
                (event == "sudo_command", F.map_concat(header, strings(command=command))),
            ],
            header,
        ),
    }


AUTH = LineFormat(fixed.AUTH, (_header, _event), _fields)


def normalize_auth(lines, assume_year=2026):
    """Lines of login logs to entries; the log has no year, so one is assumed."""
    return normalize_as(lines, [AUTH], assume_year)
