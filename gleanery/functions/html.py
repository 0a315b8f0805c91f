"""Column functions around page text: validity, lazy images, front matter."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery import constants as C
from gleanery.functions.text import or_empty, trim_space
from gleanery.schemas import METADATA_FIELDS
from gleanery.session import as_column


def _contains_any(text: Column, parts: Iterable[str]) -> Column:
    return text.rlike("|".join(re.escape(part) for part in parts))


def is_valid_content(content: Column | str, content_type: Column | str) -> Column:
    """Is there enough content, judged by bytes and by the kind of content?"""
    content = or_empty(as_column(content))
    kind = F.lower(or_empty(as_column(content_type)))
    size = F.octet_length(content)
    trimmed = F.octet_length(trim_space(content))
    return (
        F.when(kind == "", trimmed >= C.MIN_CONTENT_BYTES)
        .when(_contains_any(kind, C.STRUCTURED_TYPES), trimmed > 0)
        .when(_contains_any(kind, C.PLAIN_TEXT_TYPES), trimmed >= C.MIN_PLAIN_TEXT_BYTES)
        .when(_contains_any(kind, C.BINARY_TYPES), size > 0)
        .otherwise(size >= C.MIN_CONTENT_BYTES)
    )


def fix_lazy_images(html: Column | str) -> Column:
    """``data-src`` of an image becomes its ``src``."""
    return F.regexp_replace(
        as_column(html), r'<img([^>]*?)[\t\n\f\r ]data-src="([^"]+)"([^>]*?)>', '<img$1 src="$2"$3>'
    )


def parse_frontmatter(text: Column | str) -> Column:
    """``struct(body, meta)``; ``meta`` is null when the text has no front matter, and the last of equal keys wins."""
    text = as_column(text)
    rest = F.substr(text, F.lit(5))
    end = F.instr(rest, "\n---")
    present = text.startswith("---\n") & (end > 0)
    # A colon at the start still gives an (empty) key; a line without one is skipped.
    lines = F.filter(F.split(F.substr(rest, F.lit(1), end - 1), "\n"), lambda line: line.contains(":"))
    keys = F.transform(lines, lambda line: trim_space(F.regexp_extract(line, "^([^:]*):", 1)))
    values = F.transform(
        lines,
        lambda line: F.regexp_replace(trim_space(F.regexp_replace(line, "^[^:]*:", "")), "^[\"']+|[\"']+$", ""),
    )
    back_keys, back_values = F.reverse(keys), F.reverse(values)
    names = F.array_distinct(back_keys)
    meta = F.map_from_arrays(
        names, F.transform(names, lambda name: F.get(back_values, (F.array_position(back_keys, name) - 1).cast("int")))
    )
    body = trim_space(F.substr(rest, end + 4))
    return F.when(
        present, F.struct(body.alias("body"), meta.alias("meta"))
    ).otherwise(F.struct(text.alias("body"), F.lit(None).cast("map<string,string>").alias("meta")))


def metadata_struct(**fields: Column | str) -> Column:
    """The seven-string metadata struct; what is not given, or null, is empty."""
    return F.struct(*[
        (or_empty(as_column(fields[name])) if name in fields else F.lit("")).alias(name) for name in METADATA_FIELDS
    ])


def frontmatter_metadata(meta: Column | str, url: Column | str) -> Column:
    """Metadata from a front-matter map; the URL is the one asked for."""
    meta = as_column(meta)
    return metadata_struct(
        url=url,
        title=F.try_element_at(meta, F.lit("title")),
        description=F.try_element_at(meta, F.lit("description")),
        image=F.try_element_at(meta, F.lit("image")),
        author=F.try_element_at(meta, F.lit("author")),
        publish_date=F.try_element_at(meta, F.lit("date")),
        site_name=F.try_element_at(meta, F.lit("site_name")),
    )
