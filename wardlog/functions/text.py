"""Text helpers."""

from functools import reduce

from pyspark.sql import functions as F

# Every character Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(col):
    return F.btrim(col, F.lit(WHITESPACE))


def blank_to_null(col):
    return F.nullif(col, F.lit(""))


def contains_any(col, words):
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(w)) for w in words])


def capture(col, pattern, groups):
    """All capture groups of one anchored match as array<string>; empty without a match.

    One replace call yields every group, where regexp_extract would run the
    pattern once per group. A line holds no newline, so newline separates safely,
    and a line that does not match stays a single piece.
    """
    marked = F.regexp_replace(col, pattern, "".join(f"\n${i}" for i in range(1, groups + 1)))
    return F.slice(F.split(marked, "\n", -1), 2, groups)


def matched(parts):
    """Whether capture found a match."""
    return F.get(parts, F.lit(0)).isNotNull()


def extract(col, pattern, group):
    """One group of the first match anywhere; null when absent or empty."""
    return blank_to_null(F.regexp_extract(col, pattern, group))


def case(pairs, otherwise=None):
    """CASE WHEN over (condition, value) pairs."""
    col = None
    for condition, value in pairs:
        value = value if not isinstance(value, (str, int, float)) else F.lit(value)
        col = F.when(condition, value) if col is None else col.when(condition, value)
    if otherwise is None:
        return col
    return col.otherwise(otherwise if not isinstance(otherwise, (str, int, float)) else F.lit(otherwise))


# a string with the brackets that close behind it, or what lies between strings; then a separator or the end
JSON_TOKEN = r'("(?:[^"\\]++|\\.?)*+(?:"[\]}]*+|$)|[^",:]++)([,:]|$)'


def spaced_json(json, chars):
    """The first ``chars`` characters of compact JSON text, written with a blank behind each comma
    and colon and with other than ASCII characters as ``\\u`` escapes."""
    spaced = F.regexp_replace(F.substring(json, 1, chars), JSON_TOKEN, "$1$2 ")
    part = F.substring(F.regexp_replace(spaced, r"\} $", "}"), 1, chars)
    escape = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    escaped = F.transform(F.split(part, ""), lambda c: F.when(c <= "\x7f", c).otherwise(escape(c)))
    return F.when(part.rlike(r"[^\x00-\x7F]"), F.substring(F.array_join(escaped, ""), 1, chars)).otherwise(part)
