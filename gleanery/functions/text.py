"""Text functions.  All are plain Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery import constants as C
from gleanery.session import as_column

def trim_space(text: Column | str) -> Column:
    """Strip Unicode white space at both ends (``F.trim`` alone strips U+0020 only)."""
    return F.btrim(as_column(text), F.lit(C.UNICODE_SPACE))


def sanitize_text(text: Column | str) -> Column:
    """Each run of ASCII white space becomes one space; then trim."""
    return trim_space(F.regexp_replace(as_column(text), r"[\t\n\f\r ]+", " "))


def truncate_chars(text: Column | str, limit: int) -> Column:
    """The first ``limit`` characters followed by ``...``; shorter text is unchanged."""
    text = as_column(text)
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def truncate_bytes(text: Column | str, limit: int) -> Column:
    """At most ``limit`` bytes of UTF-8, never ending inside a character; ``limit <= 0`` means no limit."""
    text = as_column(text)
    if limit <= 0:
        return text
    raw = text.cast("binary")

    def starts_character(position: int) -> Column:
        byte = F.substring(raw, position, 1)
        return (byte < F.lit(b"\x80")) | (byte > F.lit(b"\xbf"))

    # A UTF-8 character has at most four bytes: walk back from the cut to the start of one.
    kept = F.when(starts_character(limit + 1), limit)
    for back in (1, 2):
        if limit - back >= 0:
            kept = kept.when(starts_character(limit + 1 - back), limit - back)
    cut = F.substring(raw, F.lit(1), kept.otherwise(max(limit - 3, 0))).cast("string")
    return F.when(F.octet_length(text) <= limit, text).otherwise(cut)


def collapse_newlines(text: Column | str) -> Column:
    """Three or more newlines in a row become two."""
    return F.regexp_replace(as_column(text), "\n{3,}", "\n\n")


def strip_tags(text: Column | str) -> Column:
    """Remove everything that looks like a tag."""
    return F.regexp_replace(as_column(text), "<[^>]+>", "")


def trunc2(value: Column | str) -> Column:
    """Two decimals, cut toward zero."""
    return (as_column(value) * 100).cast("bigint") / F.lit(100.0)


def non_empty(text: Column) -> Column:
    """Null for the empty string, so that ``coalesce`` can fall through it."""
    return F.nullif(text, F.lit(""))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
