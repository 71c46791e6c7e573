"""Web-firewall CSV rows."""

from pyspark.sql import functions as F

from wardlog import fixed_values as fixed
from wardlog.functions.text import case, strip
from wardlog.functions.times import as_instant, without_zone
from wardlog.operators.line_format import LineFormat, normalize_as, strings

# a comma, then a quoted cell (quotes doubled inside) or a plain one
CELL = r',(?:"[^"]*+(?:""[^"]*+)*+"[^,]*|[^,]*)'
LAST_SECOND = 253402300799


def csv_cells(line):
    """The raw cells of a one-line CSV record, each with its leading comma."""
    return F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CELL), 0)


def cell_text(cell):
    """Cell without its leading comma and quotes, stripped; '' when missing."""
    body = F.substring(cell, 2, 1 << 30)
    unquoted = F.replace(F.regexp_extract(body, r'(?s)^"(.*)"', 1), F.lit('""'), F.lit('"'))
    plain = F.when(F.startswith(body, F.lit('"')), unquoted).otherwise(body)
    return F.coalesce(strip(plain), F.lit(""))


def column_places(header):
    """Where a header line has the named cells (from 1, null when it has not), in the
    order of the fixed alias table; the first alias that is a column wins."""
    names = F.transform(csv_cells(header), lambda c: F.lower(cell_text(c)))
    place = lambda alias: F.nullif(F.array_position(names, alias), F.lit(0))
    return F.array(
        *[F.coalesce(*[place(a) for a in aliases]).cast("int") for aliases in fixed.WAF_COLUMNS.values()]
    )


def waf_clock(text):
    """Wall clock in UTC of epoch seconds, epoch milliseconds (above 1e12) or ISO text,
    whose offset is dropped, not applied."""
    number = text.try_cast("bigint")
    seconds = F.when(number > 1000000000000, F.floor(number / 1000).cast("bigint")).otherwise(number)
    epoch = F.when(seconds <= LAST_SECOND, F.timestamp_seconds(seconds).cast("timestamp_ntz"))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), without_zone(text).try_cast("timestamp_ntz"))
    return F.when(text.rlike(r"^\d+$"), epoch).otherwise(iso)


def waf_fields(value, wall):
    """Entry fields from the named cell texts and the row's time."""
    action = F.upper(value["action"])
    named = F.concat(value["method"], F.lit(" "), value["uri"], F.lit(" action="), action)
    rule = F.when(value["rule"] != "", F.concat(F.lit(" rule="), value["rule"])).otherwise("")
    return {
        "event_time": as_instant(wall),
        "event_time_local": wall,
        "source_ip": value["client_ip"],
        "endpoint": value["uri"],
        "method": value["method"],
        "event_type": case([(action == a, t) for a, t in fixed.WAF_EVENTS.items()], "waf_event"),
        "message": F.substring(F.concat(named, rule), 1, 2000),
        "raw_line": F.lit(""),
        "extra_fields": strings(
            host=value["host"], country=value["country"], action=action, terminating_rule=value["rule"]
        ),
    }


def _cells(assume_year):
    return {"waf_cells": csv_cells(F.col("raw_line"))}


def _values(assume_year):
    cell = lambda i: F.get("waf_cells", F.get("waf_columns", F.lit(i)) - 1)
    return {f"waf_{name}": cell_text(cell(i)) for i, name in enumerate(fixed.WAF_COLUMNS)}


def _cell_texts(assume_year):
    place = lambda i: F.get("waf_columns", F.lit(i)) - 1
    text = lambda i: F.coalesce(strip(F.get("waf_cells", place(i))), F.lit(""))
    return {f"waf_{name}": text(i) for i, name in enumerate(fixed.WAF_COLUMNS)}


def _time(assume_year):
    return {"waf_time": waf_clock(F.col("waf_timestamp"))}


def _fields(assume_year):
    return waf_fields({n: F.col(f"waf_{n}") for n in fixed.WAF_COLUMNS}, F.col("waf_time"))


WAF = LineFormat(fixed.WAF, (_cells, _values, _time), _fields, lambda: F.col("line_number") > 1)


# records that a CSV reader has cut into cells (see read_cells)
WAF_CELLS = LineFormat(fixed.WAF, (_cell_texts, _time), _fields, lambda: F.col("line_number") > 1)


def normalize_cells(cells, formats):
    """Records of CSV exports, each with the header of its own file, to entries.

    ``formats`` is the result of detect_format; the files in ``cells`` are few, those
    whose lines are not their records.
    """
    places = formats.filter(F.col("format") == fixed.WAF).select("source_file", "waf_columns").distinct()
    return normalize_as(cells.join(places, "source_file"), [WAF_CELLS], None)


def normalize_waf(rows):
    """CSV rows with named columns (see read_waf_csv) to entries."""
    by_name = {}
    for column in rows.columns:
        by_name.setdefault(column.strip().lower(), column)
    values = {}
    for name, aliases in fixed.WAF_COLUMNS.items():
        column = next((by_name[a] for a in aliases if a in by_name), None)
        text = F.lit("") if column is None else F.coalesce(strip(F.col(f"`{column}`").cast("string")), F.lit(""))
        values[f"waf_{name}"] = text
    named = rows.select("job_id", "line_number", *[v.alias(k) for k, v in values.items()])
    parsed = LineFormat(fixed.WAF, (_time,), _fields)
    return normalize_as(named, [parsed], None)
