"""Text expressions: trimming, link stripping, normalisation, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that str.strip() removes in Python.
STRIP_CODES = [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
STRIP_CHARS = "".join(map(chr, STRIP_CODES))

# Fixed value: a markdown link, group 1 is the visible text.
LINK_PATTERN = r"\[([^\]]+)\]\([^)]+\)"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_all(col: Column | str) -> Column:
    """Remove every kind of white space at both ends (``trim`` removes spaces only)."""
    return F.btrim(_c(col), F.lit(STRIP_CHARS))


def upper_trim(col: Column | str) -> Column:
    return F.upper(F.trim(_c(col)))


def vocab_text(col: Column | str) -> Column:
    """Form in which category values enter a vocabulary."""
    return F.upper(strip_all(col))


def strip_links(col: Column | str) -> Column:
    """``[text](url)`` becomes ``text``; NULL stays NULL."""
    return F.regexp_replace(_c(col), LINK_PATTERN, "$1")


def one_line(col: Column | str) -> Column:
    """Strip, then line feeds to spaces and carriage returns removed."""
    return F.translate(strip_all(col), "\n\r", " ")


def contains_ignore_case(col: Column | str, needle: str) -> Column:
    return F.lower(_c(col)).contains(needle.lower())


def request_key(prefix: str, *cols: str) -> Column:
    """Reuse key of a request: equal keys get equal answers.

    Parts are joined by ``_``. A ``_`` or ``\\`` inside a part is escaped and NULL is ``\\N``, so
    different requests never share a key.
    """

    def part(name: str) -> Column:
        text = F.regexp_replace(F.col(name).cast("string"), r"([\\_])", r"\\$1")
        return F.coalesce(text, F.lit("\\N"))

    return F.concat_ws("_", F.lit(prefix), *[part(c) for c in cols])
