"""Main content, Markdown and metadata of a table of pages.

Pages are parsed once each, in one Arrow stage between the scan and everything else; URL rules, validity, byte counts
and defaults are Catalyst expressions around it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery import constants as C
from gleanery.functions.head import head_fields, page_tags, page_titles
from gleanery.functions.html import is_valid_content, metadata_struct
from gleanery.functions.markup import PageReader, markdown, parse
from gleanery.functions.text import non_empty, or_empty, sanitize_text
from gleanery.functions.urls import url_domain
from gleanery.schemas import METADATA_FIELDS
from gleanery.session import as_column

# Pages of a batch whose texts are Python strings at one time.
PAGES = 256
_PARSED = T.StructType(
    [T.StructField("content", T.StringType()), T.StructField("selector", T.StringType())]
    + [T.StructField(name, T.StringType()) for name in METADATA_FIELDS]
)


def parse_page_udf(max_bytes: int = 0, bare_text: bool = True):
    """``f(html, is_wechat) -> struct``.  Marked as non-deterministic so that a filter on the result cannot make
    Catalyst run it a second time."""

    @F.arrow_udf(returnType=_PARSED)
    def parse_page(html: pa.Array, is_wechat: pa.Array) -> pa.Array:
        reader = PageReader(
            C.COMMON_SELECTORS, C.WECHAT_SELECTORS, C.FALLBACK_SELECTOR, C.MIN_CONTENT_BYTES, max_bytes, bare_text
        )
        parts = []
        for first in range(0, max(len(html), 1), PAGES):
            columns = [[] for _ in _PARSED.fields]
            for page, wechat in zip(html.slice(first, PAGES), is_wechat.slice(first, PAGES)):
                content, selector, metadata = reader.read(page.as_py() or "", bool(wechat.as_py()))
                for column, value in zip(columns, (content, selector, *metadata)):
                    column.append(value)
            parts.append(pa.StructArray.from_arrays(
                [pa.array(values, pa.string()) for values in columns], names=_PARSED.fieldNames()))
        return pa.concat_arrays(parts)

    return parse_page.asNondeterministic()


def html_to_markdown_udf(max_bytes: int = 0, bare_text: bool = True):
    """``f(html) -> markdown`` of the whole fragment; register it to use it in SQL."""

    @F.arrow_udf(returnType=T.StringType())
    def html_to_markdown(html: pa.Array) -> pa.Array:
        return pa.array(
            [None if not page.is_valid else markdown(parse(page.as_py()), max_bytes, bare_text) for page in html],
            pa.string(),
        )

    return html_to_markdown


def html_to_markdown(html: Column | str, max_bytes: int = 0, bare_text: bool = True) -> Column:
    return html_to_markdown_udf(max_bytes, bare_text)(as_column(html))


def extract_content(
    df: DataFrame,
    url: str = "url",
    html: str = "html",
    max_bytes: int = 0,
    bare_text: bool = True,
    keep_html: bool = False,
) -> DataFrame:
    """Replace the ``html`` column by ``content``, ``selector``, ``metadata`` and ``content_length``.

    ``bare_text=False`` keeps only the text inside headings, emphasis, links, code and quotes.
    """
    page_url = F.col(url)
    parsed = F.col("_parsed")
    metadata = metadata_struct(
        url=F.coalesce(non_empty(parsed["url"]), page_url),
        title=sanitize_text(parsed["title"]),
        description=sanitize_text(parsed["description"]),
        image=parsed["image"],
        author=parsed["author"],
        publish_date=parsed["publish_date"],
        site_name=F.coalesce(non_empty(sanitize_text(parsed["site_name"])), url_domain(page_url)),
    )
    kept = [c for c in df.columns if keep_html or c != html]
    return (
        df.select(*kept, parse_page_udf(max_bytes, bare_text)(
            F.col(html), or_empty(page_url).contains(C.WECHAT_URL_PART)).alias("_parsed"))
        .select(
            *kept,
            parsed["content"].alias("content"),
            parsed["selector"].alias("selector"),
            metadata.alias("metadata"),
            F.octet_length(parsed["content"]).cast("long").alias("content_length"),
        )
    )


def extract_metadata(df: DataFrame, url: str = "url", html: str = "html", keep_html: bool = False) -> DataFrame:
    """Replace the ``html`` column by ``metadata`` alone, the same that :func:`extract_content` gives, without its reader:
    expressions on the page's titles, ``meta`` and ``link`` tags.  A null page has none of them.
    """
    page_url = F.col(url)
    kept = [c for c in df.columns if keep_html or c != html]
    tagged = df.select(*kept, page_tags(F.col(html)).alias("_tags"))
    read = tagged.select(*kept, head_fields(F.col("_tags")).alias("_head"), page_titles(F.col("_tags")).alias("_title"))
    head = [non_empty(F.get("_head", F.lit(k))) for k in range(9)]
    metadata = metadata_struct(
        url=F.coalesce(head[0], page_url),
        title=sanitize_text(F.coalesce(head[1], F.col("_title"))),
        description=sanitize_text(F.coalesce(head[2], head[3])),
        image=head[4], author=head[5], publish_date=head[6],
        site_name=F.coalesce(non_empty(sanitize_text(F.coalesce(head[7], head[8]))), url_domain(page_url)),
    )
    return read.select(*kept, metadata.alias("metadata"))


def with_validity(df: DataFrame, content_type: Column | str) -> DataFrame:
    """Add ``valid``."""
    return df.withColumn("valid", is_valid_content(F.col("content"), content_type))
