"""JSON lines."""

from pyspark.sql import functions as F

from wardlog import fixed_values as fixed
from wardlog.functions.text import blank_to_null, case, strip
from wardlog.functions.date_words import clock_of_words, close_digits, date_of_words, date_words, time_of_day
from wardlog.functions.times import (
    as_instant, iso_clock, offset_seconds, without_weekday, zone_parts,
)
from wardlog.operators.line_format import LineFormat, normalize_as, strings

STRICT = {"allowSingleQuotes": "false"}
# keys that fill a field; size keys stay among the extra fields as well
STANDARD_KEYS = sorted(
    {
        key.lower()
        for keys in (
            fixed.JSON_TIME, fixed.JSON_IP, fixed.JSON_USER, fixed.JSON_ENDPOINT, fixed.JSON_METHOD,
            fixed.JSON_STATUS, fixed.JSON_MESSAGE, fixed.JSON_EVENT, fixed.JSON_LEVEL,
        )
        for key in keys
    }
)


def parse_alone(line, value_type):
    """The line parsed as array elements: one element if it is one JSON value.

    Parsed inside brackets, so text behind the value makes the line invalid.
    """
    return F.from_json(F.concat(F.lit("["), line, F.lit("]")), f"array<{value_type}>", STRICT)


def only_one(parsed):
    return F.when(F.size(parsed) == 1, F.get(parsed, F.lit(0)))


def objects_in(line):
    return F.when(F.startswith(line, F.lit("{")), parse_alone(line, "map<string,string>"))


def arrays_in(line):
    return F.when(F.startswith(line, F.lit("[")), parse_alone(line, "array<string>"))


def is_json(line):
    """Whether the line is one JSON object or array."""
    return only_one(objects_in(line)).isNotNull() | only_one(arrays_in(line)).isNotNull()


# field -> its key aliases
LOOKUPS = {
    "time": fixed.JSON_TIME, "ip": fixed.JSON_IP, "user": fixed.JSON_USER, "endpoint": fixed.JSON_ENDPOINT,
    "method": fixed.JSON_METHOD, "status": fixed.JSON_STATUS, "size": fixed.JSON_SIZE,
    "message": fixed.JSON_MESSAGE, "event": fixed.JSON_EVENT, "level": fixed.JSON_LEVEL,
}


def _parsed(assume_year):
    line = F.col("raw_line")
    return {"json_objects": objects_in(line), "json_arrays": arrays_in(line)}


def _single(assume_year):
    return {"json_map": only_one(F.col("json_objects")), "json_items": only_one(F.col("json_arrays"))}


def _keys(assume_year):
    """Keys and values back to front, so that the last of several equal keys is found."""
    return {
        "json_keys": F.reverse(F.map_keys("json_map")),
        "json_values": F.reverse(F.map_values("json_map")),
    }


def _lowered(assume_year):
    return {"json_lowered": F.transform("json_keys", F.lower)}


def _present(assume_year):
    """Per field the first alias that is a key in any case; an exact key would be one too."""
    out = {}
    for field, aliases in LOOKUPS.items():
        names = F.array(*[F.lit(a.lower()) for a in aliases])
        out[f"json_{field}_key"] = F.get(F.array_intersect(names, F.col("json_lowered")), F.lit(0))
    return out


def _places(assume_year):
    """Where each field's value is: at the exact key, else at the key in other case."""
    out = {}
    for field, aliases in LOOKUPS.items():
        key = F.col(f"json_{field}_key")
        exact = case([(key == a.lower(), a) for a in aliases if a != a.lower()], key) if any(
            a != a.lower() for a in aliases
        ) else key
        out[f"json_{field}_at"] = F.array_position("json_keys", exact)
        out[f"json_{field}_near"] = F.array_position("json_lowered", key)
    return out


def _found(assume_year):
    out = {}
    for field in LOOKUPS:
        at, near = F.col(f"json_{field}_at"), F.col(f"json_{field}_near")
        out[f"json_{field}"] = F.get("json_values", (F.when(at > 0, at).otherwise(near) - 1).cast("int"))
    return out


def _time_texts(assume_year):
    return {"json_zoned": zone_parts(F.col("json_time"))}


def _body(assume_year):
    return {"json_body": strip(F.coalesce(F.get("json_zoned", F.lit(0)), "json_time"))}


def _iso(assume_year):
    return {"json_iso": iso_clock(F.col("json_body")), "json_undated": without_weekday(F.col("json_body"))}


def _timed(assume_year):
    return {"json_timed": time_of_day(F.col("json_undated"))}


def _words(assume_year):
    return {"json_words": F.when(F.col("json_iso").isNull(), date_words(F.col("json_undated"), F.col("json_timed")))}


def _dated(assume_year):
    words = F.col("json_words")
    return {"json_date": date_of_words(words), "json_close": close_digits(words, F.col("json_timed"))}


def _times(assume_year):
    free = clock_of_words(F.col("json_date"), F.col("json_close"), F.col("json_timed"))
    return {
        "json_clock": F.coalesce("json_iso", free),
        "json_offset": offset_seconds(F.get("json_zoned", F.lit(1))),
    }


def _extra():
    """Keys outside the alias lists; of equal keys the last."""
    entries = F.map_entries("json_map")
    keys = F.map_keys("json_map")
    kept = F.filter(
        entries,
        lambda e, i: ~F.lower(e["key"]).isin(STANDARD_KEYS)
        & (F.array_position(F.col("json_keys"), e["key"]) == F.size(keys) - i),
    )
    return F.map_from_entries(kept)


def _fields(assume_year):
    line = F.col("raw_line")
    is_object, is_array = F.col("json_map").isNotNull(), F.col("json_items").isNotNull()
    length = F.size("json_items").cast("string")
    event = F.coalesce(
        blank_to_null(F.col("json_event")), F.lower(blank_to_null(F.col("json_level"))), F.lit("log_entry")
    )
    return {
        "event_time": as_instant(F.col("json_clock"), F.col("json_offset")),
        "event_time_local": F.col("json_clock"),
        "source_ip": F.col("json_ip"),
        "username": F.col("json_user"),
        "endpoint": F.col("json_endpoint"),
        "method": F.col("json_method"),
        "status_code": F.col("json_status").try_cast("int"),
        "response_size": F.col("json_size").try_cast("bigint"),
        "event_type": case([(is_object, event), (is_array, "json_array")], "unparsed"),
        "message": case(
            [
                (is_object, F.coalesce(blank_to_null(F.col("json_message")), F.substring(line, 1, 500))),
                (is_array, F.concat(F.lit("Array with "), length, F.lit(" elements"))),
            ],
            line,
        ),
        "extra_fields": case([(is_object, _extra()), (is_array, strings(array_length=length))]),
    }


JSON = LineFormat(
    fixed.JSON,
    (_parsed, _single, _keys, _lowered, _present, _places, _found, _time_texts, _body, _iso, _timed, _words, _dated,
     _times),
    _fields,
)


def normalize_json(lines):
    """JSON lines to entries; nested values are kept as JSON text."""
    return normalize_as(lines, [JSON], None)
