"""Titles, ``meta`` and ``link`` tags of a page, read by expressions: no reader, no Python.

One pattern walks the page token by token, each match beginning where the last one ended, and keeps the tags wanted;
comments, other tags with their attributes, and the raw text of scripts and the like are stepped over, so nothing inside
them is taken for a tag.  A tag that is never closed ends the page.  White space between attributes is that of ASCII.
"""

from __future__ import annotations

import json
from html import unescape
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import non_empty, or_empty, trim_space
from gleanery.session import as_column

# Elements of the HTML standard whose content is text alone.
RAW_TEXT = "script style noscript iframe noembed noframes xmp textarea".split()

_ATTRS = r"""(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?|)|=)*+"""
_NAMED = r"(?=[\s/>])" + _ATTRS + ">"


def _up_to_end(name: str) -> str:
    return rf".*?(?:</{name}(?=[\s/>])[^>]*+(?:>|\z)|\z)"


_WANTED = rf"<(?:meta|link){_NAMED}|<title{_NAMED}{_up_to_end('title')}"
_RAW = "|".join(RAW_TEXT)
_SKIPPED = (
    rf"[^<]++|<(?!/?[a-z])(?![!?/])|<!--.*?(?:--!?>|\z)|<({_RAW}){_NAMED}{_up_to_end(chr(92) + '1')}"
    rf"|<(?!(?:{_RAW}|meta|link|title)[\s/>])/?[a-z][^\s/>]*+{_ATTRS}>|<(?!!--)[!?/][^>]*+>?"
)
TAGS = rf"(?is)\G(?:{_SKIPPED})*+({_WANTED})"
_ATTRIBUTE = r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?)?"""

# References that count without a semicolon, and what numbers stand for that are no characters of their own.
_OPEN_NAMES = sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name))
_OPEN = "|".join(_OPEN_NAMES)
_NUMBERS = {f"#{n}": unescape(f"&#{n};") for n in range(160) if unescape(f"&#{n};") != chr(n)}
_NUMBER = "#[0-9]++;?|#[xX][0-9a-fA-F]++;?"
_TEXT_REFERENCE = f"&(?:{_NUMBER}|[A-Za-z][A-Za-z0-9]*+;|(?:{_OPEN}))"
_VALUE_REFERENCE = f"&(?:{_NUMBER}|[A-Za-z][A-Za-z0-9]*+;?+=?)"


def _references() -> Column:
    """Text by reference: one constant of the plan."""
    return F.from_json(F.lit(json.dumps(html5 | _NUMBERS)), "map<string,string>")


def _character(reference: Column, known: Column) -> Column:
    """Of a numeric reference."""
    hexadecimal = reference.rlike("^&#[xX]")
    digits = F.regexp_replace(reference, "^&#[xX]?0*|;$", "")
    long = F.length(digits) > 7
    short = F.when(long, F.lit("0")).otherwise(digits)
    n = F.when(hexadecimal, F.conv(short, 16, 10)).otherwise(F.conv(short, 10, 10)).cast("bigint")
    n = F.coalesce(n, F.lit(0))
    last = n.bitwiseAND(F.lit(0xFFFE))
    return (
        F.when(long | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit("�"))
        .when(F.try_element_at(known, F.concat(F.lit("#"), n.cast("string"))).isNotNull(),
              F.try_element_at(known, F.concat(F.lit("#"), n.cast("string"))))
        .when((last == 0xFFFE) | n.between(0xFDD0, 0xFDEF), F.lit(""))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    )


def _closed(reference: Column, known: Column) -> Column:
    """Of a named reference, with its semicolon or as the longest name that needs none."""
    name = F.substr(reference, F.lit(2))
    open_name = F.regexp_extract(name, f"^(?:{_OPEN})", 0)
    rest = F.substr(name, F.length(open_name) + 1)
    return F.coalesce(
        F.try_element_at(known, name), F.concat(F.try_element_at(known, non_empty(open_name)), rest), reference)


def _in_value(reference: Column, known: Column) -> Column:
    """Of a named reference in an attribute, where one without a semicolon counts only if nothing name-like follows."""
    equals = reference.endswith("=")
    bare = F.regexp_replace(reference, "=$", "")
    open_value = F.when(~equals, F.try_element_at(known, F.substr(reference, F.lit(2))))
    return F.when(bare.endswith(";"), F.concat(_closed(bare, known), F.when(equals, "=").otherwise(""))).otherwise(
        F.coalesce(open_value, reference))


def _decoded(texts: Column, pattern: str, named) -> Column:
    """Every text with its references replaced."""
    known = _references()

    def one(text: Column) -> Column:
        between = F.split(text, pattern)
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        meant = F.transform(
            found, lambda r: F.when(r.startswith("&#"), _character(r, known)).otherwise(named(r, known)))
        pieces = F.zip_with(between, meant, lambda a, b: F.concat(or_empty(a), or_empty(b)))
        return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)

    return F.transform(texts, one)


def _joined(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def _attributes(tag: Column) -> Column:
    """``struct(names, values)`` of a tag's source after its name; references are left as they are."""
    values = [F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(k)) for k in (2, 3, 4)]
    joined = F.zip_with(F.zip_with(values[0], values[1], _joined), values[2], _joined)
    names = F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(1)), F.lower)
    return F.struct(names.alias("names"), joined.alias("values"))


def _value(attributes: Column, name: str) -> Column:
    """The first attribute of a name, null if there is none."""
    at = F.array_position(attributes["names"], F.lit(name)).cast("int")
    return F.when(at > 0, F.get(attributes["values"], at - 1))


def page_tags(html: Column | str) -> Column:
    """The wanted tags of a page in order, titles with their text."""
    text = F.replace(F.regexp_replace(or_empty(as_column(html)), "\r\n?", "\n"), F.lit("\0"), F.lit(""))
    return F.regexp_extract_all(text, F.lit(TAGS), F.lit(2))


def _first(rows: Column, condition) -> Column:
    return F.get(F.filter(rows, condition), 0)


def page_titles(tags: Column) -> Column:
    """The text of all titles, one after the other."""
    titles = F.filter(tags, lambda tag: tag.rlike("(?i)^<title"))
    inner = F.transform(titles, lambda tag: F.regexp_replace(
        tag, rf"(?is)^<title{_NAMED}|</title(?=[\s/>])[^>]*+>?\z", ""))
    return trim_space(F.array_join(_decoded(inner, _TEXT_REFERENCE, _closed), ""))


def head_fields(tags: Column) -> Column:
    """Decoded values, null where there is none, from :func:`page_tags`:
    ``[canonical, og:title, og:description, description, og:image, author, published, og:site_name, unnamed]``.
    """
    metas = F.transform(F.filter(tags, lambda tag: tag.rlike("(?i)^<meta")), lambda tag: _attributes(F.substr(tag, F.lit(6))))
    links = F.transform(F.filter(tags, lambda tag: tag.rlike("(?i)^<link")), lambda tag: _attributes(F.substr(tag, F.lit(6))))

    def meta(attribute: str, value: str) -> Column:
        named = _first(metas, lambda m: (_value(m, attribute) == value) & (_value(m, "content") != ""))
        return _value(named, "content")

    canonical = _value(_first(links, lambda a: (_value(a, "rel") == "canonical") & (_value(a, "href") != "")), "href")
    fields = F.array(
        canonical, meta("property", "og:title"), meta("property", "og:description"), meta("name", "description"),
        meta("property", "og:image"), meta("property", "article:author"), meta("property", "article:published_time"),
        meta("property", "og:site_name"), meta("name", ""))
    return _decoded(fields, _VALUE_REFERENCE, _in_value)
