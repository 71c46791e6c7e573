"""Web-server access and error logs."""

from pyspark.sql import functions as F

from wardlog import fixed_values as fixed
from wardlog.functions.text import capture, case, contains_any, extract, matched
from wardlog.functions.times import access_clock, access_stamp, as_instant, clock, offset_seconds
from wardlog.operators.line_format import LineFormat, normalize_as, strings


def classify_request(status, method, endpoint):
    """Event type of a request: by status first, then by path, then by method."""
    path = F.lower(endpoint)
    return case(
        [
            (status == 401, "unauthorized"),
            (status == 403, "forbidden"),
            (status == 404, "not_found"),
            (status >= 500, "server_error"),
            (status >= 400, "client_error"),
            (contains_any(path, fixed.LOGIN_PATHS), "authentication"),
            (contains_any(path, fixed.ADMIN_PATHS), "admin_access"),
            (method.isin(fixed.WRITE_METHODS), "modification"),
        ],
        "access",
    )


def _access_parts(assume_year):
    return {"access_part": capture(F.col("raw_line"), fixed.ACCESS_LINE, 11)}


def _access_stamp(assume_year):
    status = F.get("access_part", F.lit(7)).try_cast("int")
    return {
        "access_stamp": access_stamp(F.get("access_part", F.lit(3))),
        "access_status": status,
        "access_path": F.lower(F.get("access_part", F.lit(5))),
    }


def _access_values(assume_year):
    kind = classify_request(F.col("access_status"), F.get("access_part", F.lit(4)), F.col("access_path"))
    return {
        "access_time": access_clock(F.col("access_stamp")),
        "access_offset": offset_seconds(F.get("access_stamp", F.lit(6))),
        "access_event": F.when(matched("access_part"), kind).otherwise("unparsed"),
    }


def _access_fields(assume_year):
    part = [F.get("access_part", F.lit(i)) for i in range(11)]
    status, method, endpoint = F.col("access_status"), part[4], part[5]
    is_request = matched("access_part")
    return {
        "event_time": as_instant(F.col("access_time"), F.col("access_offset")),
        "event_time_local": F.col("access_time"),
        "source_ip": part[0],
        "username": F.nullif(part[2], F.lit("-")),
        "endpoint": endpoint,
        "method": method,
        "status_code": status,
        "response_size": part[8].try_cast("bigint"),
        "user_agent": part[10],
        "event_type": F.col("access_event"),
        "message": F.when(is_request, F.concat(method, F.lit(" "), endpoint, F.lit(" -> "), part[7])).otherwise(
            F.col("raw_line")
        ),
        "extra_fields": F.when(is_request, strings(referrer=part[9], protocol=part[6])),
    }


def _error_parts(assume_year):
    return {"error_part": capture(F.col("raw_line"), fixed.ERROR_LINE, 9)}


def _error_values(assume_year):
    return {"error_time": clock(*[F.get("error_part", F.lit(i)) for i in range(6)])}


def _error_fields(assume_year):
    level, pid, message = [F.get("error_part", F.lit(i)) for i in (6, 7, 8)]
    return {
        "event_time": as_instant(F.col("error_time")),
        "event_time_local": F.col("error_time"),
        "source_ip": extract(message, fixed.ERROR_CLIENT, 1),
        "event_type": F.concat(F.lit("error_"), level),
        "message": message,
        "extra_fields": strings(level=level, pid=pid),
    }


ACCESS = LineFormat(fixed.ACCESS, (_access_parts, _access_stamp, _access_values), _access_fields)
ERROR = LineFormat(
    fixed.ERROR, (_error_parts, _error_values), _error_fields, lambda: matched("error_part")
)


def normalize_access(lines):
    """Combined Log Format lines to entries."""
    return normalize_as(lines, [ACCESS], None)


def normalize_nginx_error(lines):
    """Error-log lines to entries; other lines are dropped."""
    return normalize_as(lines, [ERROR], None)
