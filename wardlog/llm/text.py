"""Word and case rules shared by the operators, as columns."""

from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = r"[\x20\x09-\x0D]+"
NO_TERM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def text_or_empty(column="text"):
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(column):
    """A-Z in lower case, all else as it is; lower() is the same for ASCII and much faster."""
    return F.when(F.octet_length(column) == F.length(column), F.lower(column)).otherwise(
        F.translate(column, UPPER, LOWER)
    )


def blank_words(column):
    """Words between ASCII white space."""
    return F.array_remove(F.split(column, BLANK), "")


def terms(column):
    """Runs of a-z, 0-9 and characters beyond ASCII, of text in ASCII lower case."""
    return F.array_remove(F.split(column, NO_TERM), "")
