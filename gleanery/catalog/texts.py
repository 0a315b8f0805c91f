"""Text rules on documents and pages."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.catalog.registry import query, table, trimmed
from gleanery.functions import html as H
from gleanery.functions import text as X
from gleanery.sources.responses import decode_body as decode

# Ideographic, no-break and line-separator spaces around the text, and blank runs inside it.
SPACED = (
    "CASE doc_id % 4 WHEN 0 THEN '　  ' || text || '  \u0085' WHEN 1 THEN '   ' "
    "WHEN 2 THEN replace(text, ' ', chr(9) || chr(10) || '  ') ELSE text END"
)


@query("sanitize", f"""
    SELECT doc_id, {trimmed(f"regexp_replace({SPACED}, '[\\t\\n\\f\\r ]+', ' ', 'g')")} AS text FROM documents""")
def sanitize(spark, folder):
    documents = table(spark, folder, "documents")
    return documents.select("doc_id", X.sanitize_text(F.expr(SPACED)).alias("text"))


@query("trim_space", f"SELECT doc_id, {trimmed(SPACED)} AS text FROM documents")
def trim_space(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.trim_space(F.expr(SPACED)).alias("text"))


def _longest_prefix(limit: int) -> str:
    """SQL side: the longest prefix of at most ``limit`` bytes, found by trying every length."""
    return (
        f"CASE WHEN strlen(text) <= {limit} THEN text ELSE substr(text, 1, list_max(list_filter("
        f"range(0, {limit + 1}), lambda k: strlen(substr(text, 1, k)) <= {limit}))) END"
    )


@query("truncate_bytes", f"""
    SELECT doc_id, {_longest_prefix(100)} AS short, {_longest_prefix(257)} AS longer, text AS whole FROM documents""")
def truncate_bytes(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", X.truncate_bytes("text", 100).alias("short"), X.truncate_bytes("text", 257).alias("longer"),
        X.truncate_bytes("text", 0).alias("whole"),
    )


@query("truncate_chars", """
    SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS shown
    FROM documents""")
def truncate_chars(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.truncate_chars("text", 50).alias("shown"))


_BROKEN_LINES = "replace(replace(text, '. ', chr(10) || chr(10) || chr(10)), ', ', chr(10) || chr(10))"


@query("collapse_newlines", f"""
    SELECT doc_id, regexp_replace({_BROKEN_LINES}, '\\n\\n\\n+', chr(10) || chr(10), 'g') AS text FROM documents""")
def collapse_newlines(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.collapse_newlines(F.expr(_BROKEN_LINES)).alias("text"))


@query("strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages")
def strip_tags(spark, folder):
    return table(spark, folder, "pages").select("page_id", X.strip_tags("html").alias("text"))


@query("trunc2", """
    SELECT event_id, CAST(trunc((value * CAST(1.2345 AS DOUBLE) - 7) * 100) AS BIGINT) / CAST(100 AS DOUBLE) AS value
    FROM events""")
def trunc2(spark, folder):
    value = F.col("value") * F.lit(1.2345) - 7
    return table(spark, folder, "events").select("event_id", X.trunc2(value).alias("value"))


_TYPES = ["", "Application/JSON; charset=utf-8", "text/plain", "image/png", "text/html"]
_CONTENT = (
    "CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN substr(text, 1, 99) WHEN 2 THEN '  ' WHEN 3 THEN '' "
    "ELSE ' ab ' END"
)


@query("content_validity", f"""
    WITH typed AS (
        SELECT doc_id, {_CONTENT} AS content, unnest({_TYPES!r}) AS content_type FROM documents)
    SELECT doc_id, content_type, CASE content_type
        WHEN '' THEN strlen({trimmed('content')}) >= 100
        WHEN 'text/plain' THEN strlen({trimmed('content')}) >= 3
        WHEN 'image/png' THEN strlen(content) > 0
        WHEN 'text/html' THEN strlen(content) >= 100
        ELSE strlen({trimmed('content')}) > 0 END AS valid
    FROM typed""")
def content_validity(spark, folder):
    typed = table(spark, folder, "documents").select(
        "doc_id", F.expr(_CONTENT).alias("content"),
        F.explode(F.array(*[F.lit(t) for t in _TYPES])).alias("content_type"),
    )
    return typed.select("doc_id", "content_type", H.is_valid_content("content", "content_type").alias("valid"))


# Front matter: none, without end mark, repeated key, line without colon, empty block, full.
_TITLED = "'---' || chr(10) || 'title: \"' || source || ': x\"' || chr(10)"
_CLOSED = "chr(10) || '---' || chr(10) || ' ' || replace(text, '---', '==') || ' '"
FRONTED = (
    f"CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN {_TITLED} || replace(text, '---', '==') "
    f"WHEN 2 THEN {_TITLED} || 'title:  second ' {'|| ' + _CLOSED} "
    f"WHEN 3 THEN {_TITLED} || 'no colon here' || chr(10) || 'date: ' || doc_id {'|| ' + _CLOSED} "
    f"WHEN 4 THEN '---' || chr(10) {'|| ' + _CLOSED} "
    f"ELSE {_TITLED} || 'description: d' || lang || chr(10) || 'image: /i.png' || chr(10) || 'author: ''a''' "
    f"|| chr(10) || 'site_name: s' || chr(10) || 'date: 2024-01-0' || (doc_id % 9) {'|| ' + _CLOSED} END"
)
_BODY = trimmed("replace(text, '---', '==')")
FRONT_BODY = f"CASE WHEN doc_id % 6 < 2 THEN {FRONTED} ELSE {_BODY} END"
FRONT_TITLE = "CASE doc_id % 6 WHEN 2 THEN 'second' WHEN 3 THEN source || ': x' WHEN 5 THEN source || ': x' ELSE '' END"
FRONT_DATE = (
    "CASE doc_id % 6 WHEN 3 THEN CAST(doc_id AS VARCHAR) WHEN 5 THEN '2024-01-0' || (doc_id % 9) ELSE '' END"
)


def front_value(full: str) -> str:
    return f"CASE doc_id % 6 WHEN 5 THEN {full} ELSE '' END"


@query("front_matter", f"""
    SELECT doc_id, {FRONT_BODY} AS body, doc_id % 6 >= 2 AS has_meta, {FRONT_TITLE} AS title,
           {front_value("'d' || lang")} AS description, {front_value("'/i.png'")} AS image,
           {front_value("'a'")} AS author, {FRONT_DATE} AS publish_date, {front_value("'s'")} AS site_name
    FROM documents""")
def front_matter(spark, folder):
    split = table(spark, folder, "documents").select("doc_id", H.parse_frontmatter(F.expr(FRONTED)).alias("split"))
    meta = H.frontmatter_metadata("split.meta", F.lit(""))
    return split.select(
        "doc_id", "split.body", F.col("split.meta").isNotNull().alias("has_meta"),
        *[meta[f].alias(f) for f in ("title", "description", "image", "author", "publish_date", "site_name")],
    )


@F.arrow_udf(returnType=T.BinaryType())
def _as_saved(text: pa.Array, how: pa.Array) -> pa.Array:
    """Bodies as a server may have sent them: gzip, GBK, or both."""
    bodies = []
    for value, kind in zip(text.to_pylist(), how.to_pylist()):
        raw = value.encode("gbk" if "gbk" in kind else "utf-8")
        bodies.append(gzip.compress(raw, 1, mtime=0) if "gzip" in kind else raw)
    return pa.array(bodies, pa.binary())


_GBK_TEXT = "'中文页面 ' || regexp_replace(text, '[^ -~]', '?'{})"


@query("decode_body", f"""
    SELECT doc_id,
           CASE WHEN doc_id % 6 = 5 THEN NULL WHEN doc_id % 6 IN (2, 3)
                THEN {_GBK_TEXT.format(", 'g'")} ELSE text END AS text,
           CASE WHEN doc_id % 6 = 5 THEN 'unsupported content encoding: br' END AS error
    FROM documents""")
def decode_body(spark, folder):
    kinds = F.array(*[F.lit(k) for k in ("plain", "gzip", "gbk", "gzip gbk", "gzip", "br")])
    saved = (
        table(spark, folder, "documents")
        .withColumn("how", F.get(kinds, (F.col("doc_id") % 6).cast("int")))
        .withColumn("text", F.when(F.col("how").contains("gbk"), F.expr(_GBK_TEXT.format("")))
                    .otherwise(F.col("text")))
        .select("doc_id", _as_saved("text", "how").alias("body"),
                F.when(F.col("doc_id") % 6 == 4, "").when(F.col("how").contains("gzip"), "GZIP")
                .when(F.col("how") == "br", "br").otherwise("").alias("content_encoding"))
    )
    return decode(saved).select("doc_id", "text", F.col("decode_error").alias("error"))
