"""Records of CSV files whose cells may hold line breaks, without reading a file in one task.

Whether a line begins inside a quoted cell depends on all lines before it. A line turns the two possible states (outside
and inside a quoted cell) into two others; most lines change nothing. The turns that do are put together within each
split, then over the splits of a file, and the state in front of every split, and so of every line, is known.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlog.session import stored

# a run of lines whose exceptions are looked up together; their kinds are bits, WORD_LINES to a number
SLOT_LINES = 256
WORD_LINES = 64
# rows of the slot table that are broadcast (a path and a few numbers, a few hundred bytes), and words in them with an exception
BROADCAST_SLOTS = 300_000
BROADCAST_EVENTS = 1_000_000
KEY = ["source_file", "slot"]
BLANK, CONTINUES, OPENS = 0, 1, 2

_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
_CELL = rf'(?:"{_INSIDE}"[^,]*+|[^",][^,]*+)?'
# a line that begins outside a quoted cell and ends inside one; the same for a line that begins inside
ENDS_INSIDE = rf'^(?:{_CELL},)*+"{_INSIDE}$'
STAYS_INSIDE = rf'^{_INSIDE}(?:"[^,]*+,(?:{_CELL},)*+"{_INSIDE})?$'


def line_turns(lines):
    """The lines that may change the state: source_file, block, line_number, and whether a line that begins outside or
    inside a quoted cell ends inside one."""
    quoted = lines.filter(F.contains("value", F.lit('"'))).select(
        "source_file", "block", "line_number",
        F.col("value").rlike(ENDS_INSIDE).alias("from_outside"), F.col("value").rlike(STAYS_INSIDE).alias("from_inside"),
    )
    return quoted.filter(F.col("from_outside") | ~F.col("from_inside"))


def with_state_before(turns, order, fixed, value, flips):
    """Adds known and flipped: the state that the last fixed turn before left (null without one), and whether the turns
    since then flip it."""
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    counted = turns.withColumn("_flips", F.coalesce(F.sum(flips.cast("long")).over(before), F.lit(0)))
    last = F.last(F.when(fixed, F.struct(value.alias("state"), F.col("_flips").alias("flips"))), ignorenulls=True)
    since = F.col("_flips") - F.coalesce(F.col("_last.flips"), F.lit(0))
    return (
        counted.withColumn("_last", last.over(before))
        .withColumn("known", F.col("_last.state"))
        .withColumn("flipped", since % 2 == 1)
        .drop("_flips", "_last")
    )


def _state(known, flipped):
    return known != flipped


def record_breaks(turns):
    """One row per line that ends a record of several lines: source_file, open (its first line), line_number (its last).

    A quote that is never closed ends nothing, so its lines stand alone.
    """
    fixed, flips = F.col("from_outside") == F.col("from_inside"), F.col("from_outside") & ~F.col("from_inside")
    order = Window.partitionBy("source_file", "block").orderBy("line_number")
    local = with_state_before(turns, order, fixed, F.col("from_outside"), flips)

    # what each split does as a whole
    after = _state(F.col("known"), F.col("flipped"))
    last = F.max(F.struct("line_number", "known", "flipped", "from_outside", "from_inside")).alias("last")
    splits = local.groupBy("source_file", "block").agg(last).select(
        "source_file", "block", F.col("last.known").alias("known"), F.col("last.flipped").alias("flipped"),
        F.col("last.from_outside").alias("from_outside"), F.col("last.from_inside").alias("from_inside"),
    )
    through = lambda state: F.when(state, F.col("from_inside")).otherwise(F.col("from_outside"))
    splits = splits.select(
        "source_file", "block",
        through(F.when(F.col("known").isNull(), F.col("flipped")).otherwise(after)).alias("from_outside"),
        through(F.when(F.col("known").isNull(), ~F.col("flipped")).otherwise(after)).alias("from_inside"),
    )
    along = Window.partitionBy("source_file").orderBy("block")
    entered = with_state_before(splits, along, fixed, F.col("from_outside"), flips).select(
        "source_file", "block", _state(F.coalesce("known", F.lit(False)), F.col("flipped")).alias("entered")
    )

    states = local.join(entered, ["source_file", "block"])
    before = _state(F.coalesce("known", "entered"), F.col("flipped"))
    states = states.withColumn("before", before).withColumn("after", through(F.col("before")))
    changes = states.filter(F.col("before") != F.col("after"))
    # a line may end one record and begin the next one's cell only on a line of its own, so each change is one or the other
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    opened = F.when(F.col("after"), F.col("line_number"))
    changes = changes.withColumn("open", F.last(opened, ignorenulls=True).over(earlier))
    last_open = changes.groupBy("source_file", "block").agg(F.max(opened).alias("last_open"))
    carried = last_open.withColumn(
        "carried", F.last("last_open", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    ).drop("last_open")
    return (
        changes.filter(~F.col("after"))
        .join(carried, ["source_file", "block"])
        .select("source_file", F.coalesce("open", "carried").alias("open"), "line_number")
    )


def exceptions(lines):
    """The lines that are not a record of their own: source_file, line_number, open, kind (blank, continuing or opening)."""
    breaks = record_breaks(line_turns(lines))
    inside = breaks.select(
        "source_file", "open", F.explode(F.sequence(F.col("open"), F.col("line_number"))).alias("line_number")
    )
    kind = F.when(F.col("line_number") == F.col("open"), OPENS).otherwise(CONTINUES)
    inside = inside.select("source_file", "line_number", "open", kind.alias("kind"))
    blank = lines.filter(F.trim("value") == "").select("source_file", "line_number")
    blank = blank.join(inside.select("source_file", "line_number"), ["source_file", "line_number"], "left_anti")
    return inside.unionByName(
        blank.select("source_file", "line_number", F.lit(None).cast("bigint").alias("open"), F.lit(BLANK).alias("kind"))
    )


def _placed(lines):
    """Adds slot, and where in it the line is: word, and bit within the word."""
    place = f"line_number - (line_number div {SLOT_LINES}) * {SLOT_LINES}"
    return lines.withColumns({
        "slot": F.expr(f"line_number div {SLOT_LINES}"), "word": F.expr(f"cast(({place}) div {WORD_LINES} as int)"),
        "bit": F.expr(f"cast(({place}) % {WORD_LINES} as int)"),
    })


def slot_words(found, slots):
    """One row per slot of the files with exceptions: source_file, slot and words, an array with the bits of the lines
    that begin no record (removed), continue one (continues) or begin one of several lines (opens), and the number of
    removed lines of the file before the word (gone)."""
    bits = lambda kinds: F.coalesce(F.expr(f"bit_or(if(kind in ({kinds}), shiftleft(1L, bit), 0L))"), F.lit(0).cast("long"))
    words = _placed(found).groupBy(*KEY, "word").agg(
        bits(f"{BLANK}, {CONTINUES}").alias("removed"), bits(f"{CONTINUES}").alias("continues"), bits(f"{OPENS}").alias("opens")
    )
    every = slots.withColumn("word", F.explode(F.sequence(F.lit(0), F.lit((SLOT_LINES - 1) // WORD_LINES))))
    none = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    every = every.join(words, [*KEY, "word"], "left").select(*KEY, "word", *[none(n) for n in ("removed", "continues", "opens")])
    earlier = Window.partitionBy("source_file").orderBy("slot", "word").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("gone", F.coalesce(F.sum(F.bit_count("removed").cast("long")).over(earlier), F.lit(0).cast("long")))
    return every.groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct("word", "gone", "removed", "continues", "opens"))).alias("words")
    )


def read_records(lines):
    """The records of the lines (source_file, block, line_number, value) of CSV files: source_file, line_number (the
    record's number, from 1) and value, its text; see split_records."""
    return split_records(lines)[0]


def split_records(lines):
    """The records of read_records, and how many lines of each file that has such lines begin none: source_file, removed.

    Quotes count as in RFC 4180; lines of blanks between records are skipped, line breaks in cells become \\n. Lines
    are read from where they are stored; only the lines of records that span several are shuffled, and the exceptions
    of a file, which its other lines meet by runs of SLOT_LINES lines. A line finds its own kind and the number of
    exceptions before it as bits of a number, so its work does not grow with the exceptions of its run.
    """
    lines = stored(lines, "csv-lines")
    found = stored(exceptions(lines), "csv-exceptions")
    lines = _placed(lines)
    files = found.select("source_file").distinct()
    slots = stored(slot_words(found, lines.join(files, "source_file", "left_semi").select(*KEY).distinct()), "csv-slots")
    eventful = F.count_if((F.col("w.removed") != 0) | (F.col("w.opens") != 0))
    events = slots.select(F.explode("words").alias("w")).agg(eventful).first()[0]
    small = slots.count() <= BROADCAST_SLOTS and events <= BROADCAST_EVENTS
    known = lines.join(F.broadcast(slots) if small else slots, KEY, "left").withColumn("w", F.get("words", F.col("word")))
    has = lambda name: F.col(f"w.{name}").bitwiseAND(F.expr("shiftleft(1L, bit)")) != 0
    before = F.col("w.gone") + F.bit_count(F.col("w.removed").bitwiseAND(F.expr("~shiftleft(-1L, bit)")))
    kind = F.when(has("continues"), CONTINUES).when(has("opens"), OPENS).when(has("removed"), BLANK)
    known = known.select(
        "source_file", "line_number", "value", (F.col("line_number") - F.coalesce(before, F.lit(0))).alias("number"), kind.alias("kind")
    )
    whole = known.filter("kind is null").select("source_file", F.col("number").alias("line_number"), "value")
    # a continuing line has all continuing lines before it removed, its record's first line is one number lower
    record = F.col("number") - F.when(F.col("kind") == CONTINUES, 1).otherwise(0)
    parts = known.filter(F.col("kind") != BLANK).groupBy("source_file", record.alias("record")).agg(
        F.sort_array(F.collect_list(F.struct("line_number", "value"))).alias("parts")
    )
    records = whole.unionByName(
        parts.select("source_file", F.col("record").alias("line_number"), F.array_join("parts.value", "\n").alias("value"))
    )
    removed = found.filter(F.col("kind") != OPENS).groupBy("source_file").agg(F.count(F.lit(1)).alias("removed"))
    return records, removed


def record_cells(records, columns):
    """The first cells of each record, as a CSV reader cuts them: waf_cells, null where a cell is empty or missing."""
    names = [f"c{i}" for i in range(columns)]
    parsed = F.from_csv("value", F.lit(", ".join(f"{n} string" for n in names)), {"quote": '"', "escape": '"'})
    return records.withColumn("_cells", parsed).select(
        "source_file", "line_number", F.array(*[F.col("_cells").getField(n) for n in names]).alias("waf_cells")
    )
