"""Column helpers for text, numbers and file names. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number spellings the table reader accepts as a number.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INFINITY_PATTERN = r"(?i)^[+-]?inf(inity)?$"

# Cell texts that mean "missing" when a CSV file is read.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Every character the reader strips from the ends of a cell.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

WORD_PATTERN = r"[\p{L}\p{N}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove white space of every kind at both ends (``trim`` removes blanks only)."""
    return F.btrim(_col(c), F.lit(WHITE_SPACE))


def norm(c: Column | str) -> Column:
    """Text form of a cell, lowered and stripped: the text-mode comparison key."""
    return strip(F.lower(_col(c).cast("string")))


def norm_value(value: object) -> str:
    return str(value).strip().lower()


def to_number(c: Column | str) -> Column:
    """Text to DOUBLE; anything that is not wholly a number becomes NULL."""
    text = strip(_col(c).cast("string"))
    return F.when(text.rlike(NUMBER_PATTERN) | text.rlike(INFINITY_PATTERN), text.try_cast("double"))


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/\\]+)$", 1)


def extension(name: Column | str) -> Column:
    """Lower-case extension with its dot; leading dots of a name are not an extension."""
    return F.lower(F.regexp_extract(base_name(name), r"^\.*[^.].*(\.[^.]*)$", 1))


def words(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits, in text order."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD_PATTERN), F.lit(0))


def iso_timestamp(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss")


def split_list(c: Column | str) -> Column:
    """A comma-separated list as an array; an empty one has no members."""
    return F.filter(F.split(_col(c), ","), lambda x: x != "")


def map_value(m: Column | str, key: str, default: object = None) -> Column:
    """Map read with a default."""
    found = F.element_at(_col(m), F.lit(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def filled(c: Column | str) -> Column:
    """NULL for NULL and for empty text: the 'was a value given?' test."""
    return F.nullif(_col(c), F.lit(""))
