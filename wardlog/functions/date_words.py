"""Free-form times, read by a small grammar over their words.

A time of day is cut out first. What is left is split into numbers and names; weekdays and joining words are dropped, and
the rest says by its order, its number of digits and a month's name which is the year, the month and the day. A text
without all three of them, or with another word, is no time.
"""

from pyspark.sql import functions as F

from wardlog.functions.text import capture, case, matched

# The words of the grammar.
MONTHS = [
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "sept",
]
WEEKDAYS = [
    "mon", "tue", "wed", "thu", "fri", "sat", "sun",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
]
JOINING = ["at", "on", "and", "ad", "m", "t", "of", "st", "nd", "rd", "th"]

# text before, hour, minute, second, fraction, a or p (with and without minutes), text behind
TIME_OF_DAY = (
    r"(?si)^(.*?)(?<!\d)(\d{1,2})(?::(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([ap])\.?m\b\.?)?|\s*([ap])\.?m\b\.?)(?![\d:])(.*)$"
)
# the name of a zone behind the time, which is not taken into account
ZONE_NAME = r"^\s*(?!(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|mon|tue|wed|thu|fri|sat|sun)[a-z]*\b)[A-Z]{3,5}\b"
CENTURY_HALF = 50


def time_of_day(text):
    """Parts of the first time of day in the text (see TIME_OF_DAY), empty without one."""
    return capture(F.replace(text, F.lit("\n"), F.lit(" ")), TIME_OF_DAY, 8)


def date_words(text, timed):
    """The numbers and month names of a text, in order and in lower case, without its time of day; null if it has
    another word."""
    behind = F.regexp_replace(F.get(timed, F.lit(7)), ZONE_NAME, "")
    rest = F.when(matched(timed), F.concat(F.get(timed, F.lit(0)), F.lit(" "), behind)).otherwise(text)
    words = F.regexp_extract_all(F.lower(rest), F.lit(r"\d+|[^\W\d_]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(*WEEKDAYS, *JOINING))
    strange = F.exists(kept, lambda w: ~w.rlike(r"^\d+$") & ~w.isin(*MONTHS))
    # six digits alone are three numbers
    alone = (F.size(kept) == 1) & F.get(kept, F.lit(0)).rlike(r"^\d{6}$")
    thirds = F.array(*[F.substring(F.get(kept, F.lit(0)), start, 2) for start in (1, 3, 5)])
    return F.when(~strange, F.when(alone, thirds).otherwise(kept))


def _month(word):
    place = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), word)
    return case([(place == 0, F.lit(None)), (place == 25, F.lit(9)), (place > 12, place - 12)], place).cast("int")


def _date(year, month, day, four_digits):
    return F.struct(
        year.cast("int").alias("year"), month.cast("int").alias("month"), day.cast("int").alias("day"),
        four_digits.alias("four_digits"),
    )


def _three(words):
    """Year, month and day of three words."""
    word = [F.get(words, F.lit(i)) for i in range(3)]
    named = [_month(w) for w in word]
    number = [w.try_cast("int") for w in word]
    wide = [F.coalesce(n.isNotNull() & (F.length(w) > 2), F.lit(False)) for n, w in zip(number, word)]
    any_wide = wide[0] | wide[1] | wide[2]
    told = lambda y, m, d: _date(number[y], named[m], number[d], wide[y])
    plain = lambda y, m, d: _date(number[y], number[m], number[d], wide[y])
    rest = lambda *taken: next(i for i in range(3) if i not in taken)
    by_name = [
        (named[m].isNotNull() & wide[y], told(y, m, rest(y, m))) for m in range(3) for y in range(3) if m != y
    ]
    return case([
        *by_name,
        (named[0].isNotNull() & (number[1] > 31), told(1, 0, 2)), (named[0].isNotNull(), told(2, 0, 1)),
        (named[1].isNotNull() & (number[0] > 31), told(0, 1, 2)), (named[1].isNotNull(), told(2, 1, 0)),
        (named[2].isNotNull() & (number[1] > 31), told(1, 2, 0)), (named[2].isNotNull(), told(0, 2, 1)),
        ((number[0] > 31) | wide[0], plain(0, 1, 2)), (number[0] > 12, plain(2, 1, 0)),
    ], plain(2, 0, 1))


def date_of_words(words):
    """Struct of year, month, day and whether the year has its century; null where the words are no date."""
    first, length = F.get(words, F.lit(0)), F.length(F.get(words, F.lit(0)))
    digits = first.rlike(r"^\d+$")
    second = F.get(words, F.lit(1))
    part = lambda start, n: F.substring(first, start, n)
    long_form = _date(part(1, 4), part(5, 2), part(7, 2), F.lit(True))
    alone, pair = F.size(words) == 1, (F.size(words) == 2) & second.rlike(r"^(\d{4}|\d{6})$")
    return case([
        (F.size(words) == 3, _three(words)),
        (digits & alone & length.isin(8, 12, 14), long_form),
        (digits & pair & (length == 8), long_form),
    ])


def close_digits(words, timed):
    """Hour, minute and second as text, from the time of day or from digits without colons, and a or p."""
    first, last = F.get(words, F.lit(0)), F.get(words, F.size(words) - 1)
    joined = case([
        (F.length(first).isin(12, 14), F.substring(first, 9, 6)),
        (F.size(words) == 2, last),
    ], "")
    at = lambda i, start: F.when(matched(timed), F.get(timed, F.lit(i))).otherwise(F.substring(joined, start, 2))
    half = F.lower(F.concat(F.coalesce(F.get(timed, F.lit(5)), F.lit("")), F.coalesce(F.get(timed, F.lit(6)), F.lit(""))))
    return F.struct(at(1, 1).alias("hour"), at(2, 3).alias("minute"), at(3, 5).alias("second"), half.alias("half"))


def clock_of_words(date, close, timed, this_year=None):
    """TIMESTAMP_NTZ of a date and its time of day (midnight without one); null when they name no real time.

    A year of two digits is the one nearest to this year: less than fifty years ahead, fifty at most behind.
    """
    now = F.year(F.current_date()) if this_year is None else F.lit(this_year)
    short = date["year"] + (now - now % 100)
    near = case([(short >= now + CENTURY_HALF, short - 100), (short < now - CENTURY_HALF, short + 100)], short)
    year = F.when(date["four_digits"] | (date["year"] > 99), date["year"]).otherwise(near)
    number = lambda text: F.coalesce(F.nullif(text, F.lit("")).try_cast("int"), F.lit(0))
    hour, half = number(close["hour"]), close["half"]
    hour = case([
        ((half != "") & (hour > 12), F.lit(None).cast("int")), ((half == "p") & (hour < 12), hour + 12),
        ((half == "a") & (hour == 12), F.lit(0)),
    ], hour)
    fraction = F.rpad(F.coalesce(F.get(timed, F.lit(4)), F.lit("")), 6, "0")
    second = number(close["second"])
    seconds = (second * 1000000 + fraction.try_cast("int")).cast("decimal(16,0)") / F.lit(1000000).cast("decimal(7,0)")
    made = F.try_make_timestamp_ntz(year, date["month"], date["day"], hour, number(close["minute"]), seconds.cast("decimal(16,6)"))
    return F.when((second < 60) & ~(matched(timed) & (close["hour"] == "")), made)
