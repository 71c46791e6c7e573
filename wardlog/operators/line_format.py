"""How a normaliser is described, and how one or several are applied in one scan.

A normaliser is a set of Column expressions over ``raw_line``: stages of helper
columns (each stage may use the ones before), the entry fields, and optionally
which lines to keep. Several normalisers share one projection per stage, each
guarded by the line's format, so mixed files are normalised in a single pass.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlog.functions.text import blank_to_null, case
from wardlog.schema import ENTRY_SCHEMA

# text fields in which '' means "absent"
OPTIONAL_TEXT = [
    "source_ip", "destination_ip", "username", "endpoint", "method", "user_agent", "event_type", "message",
]


@dataclass(frozen=True)
class LineFormat:
    name: str
    stages: tuple[Callable[[int], dict[str, Column]], ...]
    fields: Callable[[int], dict[str, Column]]
    keep: Callable[[], Column] | None = None


def strings(**pairs):
    """map<string,string> column from named values."""
    flat = []
    for key, value in pairs.items():
        flat += [F.lit(key), value]
    return F.create_map(*flat)


def normalize_as(lines, formats, assume_year):
    """Entries of ``lines``: by its one format, or by the ``format`` column of each line."""
    single = len(formats) == 1

    def only(fmt, value):
        return value if single else F.when(F.col("format") == fmt.name, value)

    df = lines
    for level in range(max(len(f.stages) for f in formats)):
        helpers = {}
        for fmt in formats:
            if level < len(fmt.stages):
                for name, value in fmt.stages[level](assume_year).items():
                    helpers[name] = only(fmt, value)
        df = df.withColumns(helpers)

    kept = [
        (F.lit(True) if single else F.col("format") == f.name) & (f.keep() if f.keep else F.lit(True))
        for f in formats
    ]
    condition = kept[0]
    for other in kept[1:]:
        condition = condition | other
    df = df.filter(condition)

    fields = {f.name: f.fields(assume_year) for f in formats}
    columns = []
    for column in ENTRY_SCHEMA:
        name, kind = column.name, column.dataType
        if name in ("job_id", "line_number"):
            columns.append(F.col(name).cast(kind).alias(name))
            continue
        default = F.col("raw_line") if name == "raw_line" else F.lit(None).cast(kind)
        if single:
            value = fields[formats[0].name].get(name, default)
        else:
            value = case(
                [
                    (F.col("format") == f.name, fields[f.name][name].cast(kind))
                    for f in formats
                    if name in fields[f.name]
                ]
                or [(F.lit(False), default)],
                default,
            )
        if name in OPTIONAL_TEXT:
            value = blank_to_null(value)
        columns.append(value.cast(kind).alias(name))
    return df.select(columns)
