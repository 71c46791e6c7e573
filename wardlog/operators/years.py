"""The year of log lines that carry none, from the order of their lines."""

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from wardlog.functions.times import month_number
from wardlog.session import stored

SLOT_LINES = 4096
BROADCAST_SLOTS = 200_000
FILE = "source_file"
KEY = [FILE, "slot"]
YEAR = "log_year"


def _turn(earlier, later):
    """1 where a new year begins between two neighbouring months, -1 where an old one comes back, else 0.

    Months that fall back begin a new year. Falling back by one month is a late line at the turn of a month, and from
    January to December one at the turn of the year.
    """
    return F.when(earlier - later >= 2, 1).when(later - earlier >= 11, -1).otherwise(0)


def year_turns(lines):
    """The lines at which the year changes: source_file, line_number, turn; see _turn.

    Neighbours are compared within runs of SLOT_LINES lines, then the last month of each run with the first of the next
    run that has one, so that no file is put in order in one task.
    """
    dated = lines.select(
        FILE, "line_number", month_number(F.substring("raw_line", 1, 3)).alias("month"),
        F.expr(f"line_number div {SLOT_LINES}").alias("slot"),
    ).filter("month is not null")
    within = dated.withColumn("before", F.lag("month").over(Window.partitionBy(*KEY).orderBy("line_number")))
    ends = dated.groupBy(*KEY).agg(
        F.min(F.struct("line_number", "month")).alias("first"), F.max(F.struct("line_number", "month")).alias("last")
    )
    along = Window.partitionBy(FILE).orderBy("slot")
    between = ends.withColumn("before", F.lag("last.month").over(along)).select(
        *KEY, F.col("first.line_number").alias("line_number"), F.col("first.month").alias("month"), "before"
    )
    found = within.filter("before is not null").unionByName(between.filter("before is not null"), True)
    return found.withColumn("turn", _turn(F.col("before"), F.col("month"))).filter("turn <> 0").select(
        *KEY, "line_number", "turn"
    )


def with_years(lines, first_year):
    """Numbered lines with ``log_year``: the year in which the line's file begins (a number or a column), moved on at
    every turn of the year before it. Pass ``F.col("log_year")`` to a normaliser as its ``assume_year``."""
    lines = lines.withColumn("slot", F.expr(f"line_number div {SLOT_LINES}"))
    turns = year_turns(lines).groupBy(*KEY).agg(
        F.sum("turn").alias("turned"), F.collect_list(F.struct("line_number", "turn")).alias("turns")
    )
    # all runs of the files with a turn
    slots = lines.select(*KEY).distinct().join(turns.select(FILE).distinct(), FILE, "left_semi").join(turns, KEY, "left")
    earlier = Window.partitionBy(FILE).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = stored(
        slots.select(*KEY, "turns", F.coalesce(F.sum("turned").over(earlier), F.lit(0)).alias("gone")), "year-turns"
    )
    if slots.count() <= BROADCAST_SLOTS:
        slots = F.broadcast(slots)
    own = F.aggregate(
        F.filter("turns", lambda t: t["line_number"] <= F.col("line_number")), F.lit(0),
        lambda total, t: total + t["turn"],
    )
    moved = F.coalesce("gone", F.lit(0)) + F.coalesce(own, F.lit(0))
    start = first_year if isinstance(first_year, Column) else F.lit(first_year)
    return lines.join(slots, KEY, "left").withColumn(YEAR, (start + moved).cast("int")).drop("slot", "turns", "gone")
