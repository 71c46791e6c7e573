"""Packet-filter logs: PF lines, kernel lines and bare key=value lines."""

from pyspark.sql import functions as F

from wardlog import fixed_values as fixed
from wardlog.functions.text import blank_to_null, capture, case, contains_any, matched
from wardlog.functions.times import as_instant, syslog_clock
from wardlog.operators.line_format import LineFormat, normalize_as, strings


def _shapes(assume_year):
    line = F.col("raw_line")
    maybe_pf = F.contains(line, F.lit("rule")) & contains_any(line, ["pass", "block"])
    return {
        "pf_part": F.when(maybe_pf, capture(line, fixed.PF_LINE, 12)),
        "kernel_part": F.when(F.contains(line, F.lit("kernel:")), capture(line, fixed.KERNEL_LINE, 8)),
    }


def _pairs(assume_year):
    """Keys and values of the message, back to front: of equal keys the last is found."""
    text = F.coalesce(F.get("kernel_part", F.lit(7)), F.col("raw_line"))
    return {
        "kv_keys": F.reverse(F.regexp_extract_all(text, F.lit(fixed.KEY_VALUE), 1)),
        "kv_values": F.reverse(F.regexp_extract_all(text, F.lit(fixed.KEY_VALUE), 2)),
    }


def _pair(key):
    at = F.array_position("kv_keys", key)
    return F.when(at > 0, F.get("kv_values", (at - 1).cast("int")))


def _action(assume_year):
    pf, kernel = matched("pf_part"), matched("kernel_part")
    named = F.coalesce(_pair("ACTION"), F.lit("unknown"))
    pairs = (_pair("SRC").isNotNull()) | (_pair("DST").isNotNull())
    return {
        "fw_shape": case([(pf, "pf"), (kernel, "kernel"), (pairs, "pairs")], "none"),
        "fw_action": case(
            [
                (pf, F.get("pf_part", F.lit(5))),
                (kernel, F.coalesce(blank_to_null(F.get("kernel_part", F.lit(6))), named)),
            ],
            F.upper(named),
        ),
        "fw_time": case(
            [
                (pf, syslog_clock(F.col("pf_part"), assume_year)),
                (kernel, syslog_clock(F.col("kernel_part"), assume_year)),
            ]
        ),
    }


def _all_pairs():
    """Every key=value pair, the last of equal keys."""
    keys = F.col("kv_keys")
    zipped = F.arrays_zip(keys.alias("key"), F.col("kv_values").alias("value"))
    kept = F.filter(zipped, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], e["value"])))


def _fields(assume_year):
    shape, action, line = F.col("fw_shape"), F.col("fw_action"), F.col("raw_line")
    is_pf, is_kernel, is_pairs = shape == "pf", shape == "kernel", shape == "pairs"
    pf = [F.get("pf_part", F.lit(i)) for i in range(12)]
    text = lambda key: F.coalesce(_pair(key), F.lit(""))
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    loud = F.upper(action)
    blocked = case(
        [
            (is_pf, action == "block"),
            (is_kernel, F.contains(loud, F.lit("BLOCK")) | F.contains(loud, F.lit("DROP"))),
        ],
        action.isin("BLOCK", "DROP", "DENY", "REJECT"),
    )
    return {
        "event_time": as_instant(F.col("fw_time")),
        "event_time_local": F.col("fw_time"),
        "source_ip": case([(is_pf, pf[8]), (is_kernel | is_pairs, _pair("SRC"))]),
        "destination_ip": case([(is_pf, pf[10]), (is_kernel | is_pairs, _pair("DST"))]),
        "event_type": case(
            [(shape == "none", "firewall_unparsed"), (blocked, "firewall_block")], "firewall_allow"
        ),
        "message": case(
            [
                (is_pf, join(action, " ", pf[6], " ", pf[8], ":", pf[9], " -> ", pf[10], ":", pf[11])),
                (
                    is_kernel,
                    join(
                        action, " ", text("PROTO"), " ", text("SRC"), ":", text("SPT"),
                        " -> ", text("DST"), ":", text("DPT"),
                    ),
                ),
                (is_pairs, F.substring(line, 1, 500)),
            ],
            line,
        ),
        "extra_fields": case(
            [
                (
                    is_pf,
                    strings(
                        action=action, direction=pf[6], interface=pf[7],
                        source_port=pf[9], destination_port=pf[11],
                    ),
                ),
                (
                    is_kernel,
                    strings(
                        action=action, protocol=_pair("PROTO"), source_port=_pair("SPT"),
                        destination_port=_pair("DPT"), interface_in=_pair("IN"),
                        interface_out=_pair("OUT"), hostname=F.get("kernel_part", F.lit(5)),
                    ),
                ),
                (is_pairs, _all_pairs()),
            ]
        ),
    }


FIREWALL = LineFormat(fixed.FIREWALL, (_shapes, _pairs, _action), _fields)


def normalize_firewall(lines, assume_year=2026):
    """Packet-filter lines to entries; PF form first, then kernel form, then key=value."""
    return normalize_as(lines, [FIREWALL], assume_year)
