"""Saved service answers, built from pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.catalog.registry import query, table, trimmed
from gleanery.catalog.texts import FRONT_BODY, FRONT_DATE, FRONT_TITLE, FRONTED, front_value
from gleanery.catalog.urls import HOST
from gleanery.operators import providers as P

TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
ARTICLE = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"
META = ("url", "title", "description", "image", "author", "publish_date", "site_name")


def _flat(candidates: DataFrame) -> DataFrame:
    """Candidate columns without structs; the URL identifies the row."""
    return candidates.select(
        F.col("url").alias("key"), "mode", "content", "selector", *[F.col(f"metadata.{m}").alias(m) for m in META],
        "error",
    )


def _expected(source: str, key: str, mode: str, selector: str, error: str, **values: str) -> str:
    """SQL side: the same columns; a row with an error has nothing else."""
    def shown(name: str) -> str:
        return f"CASE WHEN error IS NULL THEN {values.get(name, chr(39) * 2)} ELSE '' END AS {name}"

    return f"""
        WITH judged AS (SELECT *, {error} AS error FROM {source})
        SELECT {key} AS key, '{mode}' AS mode, {shown('content')},
               CASE WHEN error IS NULL THEN '{selector}' ELSE '' END AS selector,
               {', '.join(shown(m) for m in META)}, error
        FROM judged"""


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields))


def _named(name: str, expression: str | Column) -> Column:
    return (F.expr(expression) if isinstance(expression, str) else expression).alias(name)


def _present(modulus: int, expression: str) -> str:
    """Null (and so left out of the JSON) on every ``modulus``-th page."""
    return f"CASE WHEN page_id % {modulus} = 0 THEN NULL ELSE {expression} END"


def _or(modulus: int, expression: str, otherwise: str) -> str:
    return f"CASE WHEN page_id % {modulus} = 0 THEN {otherwise} ELSE {expression} END"


SCRAPE_ERROR = (
    "CASE page_id % 11 WHEN 1 THEN 'firecrawl 返回失败: success=false' WHEN 2 THEN 'firecrawl 返回失败: success=true' "
    "WHEN 3 THEN 'firecrawl 解析 JSON 失败' WHEN 4 THEN 'firecrawl HTTP 503: not json' END"
)


def scrape_answers(pages: DataFrame) -> DataFrame:
    body = _json(
        _named("success", "page_id % 11 <> 1"),
        F.struct(
            _named("markdown", f"CASE WHEN page_id % 11 = 2 THEN '' ELSE '  ' || {ARTICLE} || '  ' END"),
            F.struct(
                _named("title", _present(2, TITLE)), _named("description", _present(3, "'d ' || page_id")),
                _named("ogTitle", "'og ' || page_id"), _named("ogDescription", "'ogd ' || page_id"),
                _named("ogImage", "'/i/' || page_id"), _named("author", _present(5, "'a'")),
                _named("sourceURL", _present(7, "'https://s.example/' || page_id")),
            ).alias("metadata"),
        ).alias("data"),
    )
    return pages.select(
        "url", F.when(F.expr("page_id % 11 IN (3, 4)"), "not json").otherwise(body).alias("body"),
        F.when(F.expr("page_id % 11 = 4"), 503).otherwise(200).alias("status"),
    )


@query("firecrawl_parse", _expected(
    "pages", "url", "firecrawl", "firecrawl", SCRAPE_ERROR, content=trimmed(f"'  ' || {ARTICLE}"),
    url=_or(7, "'https://s.example/' || page_id", "url"), title=_or(2, TITLE, "'og ' || page_id"),
    description=_or(3, "'d ' || page_id", "'ogd ' || page_id"), image="'/i/' || page_id", author=_or(5, "'a'", "''"),
    site_name=HOST,
))
def firecrawl_parse(spark, folder):
    return _flat(P.firecrawl_candidates(scrape_answers(table(spark, folder, "pages")), max_bytes=0))


SNAPSHOT_ERROR = (
    "CASE page_id % 11 WHEN 1 THEN 'webpagesnap 返回失败: success=false, body 为空' "
    "WHEN 2 THEN 'webpagesnap 返回失败: success=true, body 为空' WHEN 3 THEN 'webpagesnap 解析 JSON 失败' "
    "WHEN 4 THEN 'webpagesnap HTTP 500' END"
)


def snapshot_answers(pages: DataFrame) -> DataFrame:
    body = _json(
        _named("success", "page_id % 11 <> 1"), _named("url", "url"),
        _named("finalUrl", _present(7, "'https://f.example/' || page_id")),
        F.struct(
            _named("title", TITLE), _named("description", "'  plain   d '"), _named("author", "'a'"),
            _named("ogTitle", _present(2, "' og   ' || page_id")), _named("ogDescription", _present(3, "' og d  '")),
            _named("ogImage", _present(5, "'/og/' || page_id")), _named("twitterImage", "'/tw/' || page_id"),
        ).alias("header"),
        _named("body", f"CASE WHEN page_id % 11 = 2 THEN '' ELSE chr(10) || {ARTICLE} || ' ' END"),
    )
    return pages.select(
        "url", F.when(F.expr("page_id % 11 = 3"), '{"success": tr').otherwise(body).alias("body"),
        F.when(F.expr("page_id % 11 = 4"), 500).otherwise(200).alias("status"),
    )


@query("webpagesnap_parse", _expected(
    "pages", "url", "webpagesnap", "webpagesnap", SNAPSHOT_ERROR, content=trimmed(ARTICLE),
    url=_or(7, "'https://f.example/' || page_id", "url"),
    title=_or(2, "'og ' || page_id", trimmed(f"regexp_replace({TITLE}, '[\\t\\n\\f\\r ]+', ' ', 'g')")),
    description=_or(3, "'og d'", "'plain d'"), image=_or(5, "'/og/' || page_id", "'/tw/' || page_id"), author="'a'",
    site_name=HOST,
))
def webpagesnap_parse(spark, folder):
    return _flat(P.webpagesnap_candidates(snapshot_answers(table(spark, folder, "pages")), max_bytes=0))


_DOC_URL = "'https://d.example/' || doc_id"


def reader_answers(documents: DataFrame) -> DataFrame:
    """Text with and without front matter, as the Markdown readers return it."""
    return documents.select(
        F.expr(_DOC_URL).alias("url"), F.expr(FRONTED).alias("body"),
        F.when(F.expr("doc_id % 13 = 0"), 404).otherwise(200).alias("status"),
    )


def _collapsed(expression: str) -> str:
    return f"regexp_replace({expression}, '\\n\\n\\n+', chr(10) || chr(10), 'g')"


@query("markdownnew_parse", _expected(
    "documents", _DOC_URL, "markdown-new", "markdown-new",
    "CASE WHEN doc_id % 13 = 0 THEN 'markdown.new HTTP 404' END", content=trimmed(FRONT_BODY), url=_DOC_URL,
    title=FRONT_TITLE, description=front_value("'d' || lang"), site_name="'d.example'",
))
def markdownnew_parse(spark, folder):
    return _flat(P.markdownnew_candidates(reader_answers(table(spark, folder, "documents")), max_bytes=0))


@query("defuddle_parse", _expected(
    "documents", _DOC_URL, "defuddle", "defuddle-reader", "CASE WHEN doc_id % 13 = 0 THEN 'Defuddle HTTP 404' END",
    content=trimmed(_collapsed(FRONT_BODY)), url=_DOC_URL, title=FRONT_TITLE, description=front_value("'d' || lang"),
    image=front_value("'/i.png'"), author=front_value("'a'"), publish_date=FRONT_DATE, site_name=front_value("'s'"),
))
def defuddle_parse(spark, folder):
    return _flat(P.defuddle_candidates(reader_answers(table(spark, folder, "documents"))))


@query("jina_parse", _expected(
    "documents", _DOC_URL, "jina", "jina-reader", "CASE WHEN doc_id % 13 = 0 THEN 'Jina HTTP 404' END",
    content=_collapsed(trimmed("text")), url=_DOC_URL,
))
def jina_parse(spark, folder):
    raw = table(spark, folder, "documents").select(
        F.expr(_DOC_URL).alias("url"), F.concat(F.lit(" \n"), "text", F.lit("\n\n")).alias("body"),
        F.when(F.expr("doc_id % 13 = 0"), 404).otherwise(200).alias("status"),
    )
    return _flat(P.jina_candidates(raw))


_TWEET_URL = "'https://x.com/u' || conv_id || '/status/' || turn"
_TWEET_LINK = (
    "CASE WHEN (conv_id + turn) % 9 = 4 THEN 'http://x.com/u' || conv_id || '/status/' || turn "
    f"ELSE {_TWEET_URL} || '?s=20' END"
)
TWEET_ERROR = (
    f"CASE (conv_id + turn) % 9 WHEN 1 THEN 'fxtwitter 返回失败: code=404' "
    f"WHEN 2 THEN 'fxtwitter 返回失败: code=200' WHEN 3 THEN 'fxtwitter 解析 JSON 失败' "
    f"WHEN 4 THEN '无法识别 Twitter/X URL 格式: ' || {_TWEET_LINK} END"
)
_PHOTO = "'https://p.example/' || conv_id || '.jpg'"


def tweet_answers(conversations: DataFrame) -> DataFrame:
    def items(name: str, count: str, *fields: Column) -> Column:
        both = F.array(F.struct(*fields), F.struct(*fields))
        return F.slice(both, F.lit(1), F.expr(count).cast("int")).alias(name)

    body = _json(
        _named("code", "CASE WHEN (conv_id + turn) % 9 = 1 THEN 404 ELSE 200 END"),
        F.struct(
            _named("url", _TWEET_URL), _named("id", "CAST(conv_id AS STRING)"),
            _named("text", "CASE WHEN (conv_id + turn) % 9 = 2 THEN '' ELSE text END"),
            F.struct(_named("name", "role"), _named("screen_name", "'u' || conv_id"),
                     _named("avatar_url", "CASE WHEN turn % 5 = 0 THEN NULL ELSE '/a/' || conv_id END")).alias("author"),
            F.struct(
                items("photos", "turn % 3", _named("url", _PHOTO), F.lit(640).alias("width")),
                items("videos", "turn % 2", _named("url", "'https://v.example/' || turn")),
            ).alias("media"),
            _named("likes", "conv_id"), _named("retweets", "CASE WHEN turn % 4 = 0 THEN NULL ELSE turn END"),
            _named("replies", "CAST(3000000000 AS BIGINT)"),
        ).alias("tweet"),
    )
    return conversations.select(
        F.expr(_TWEET_LINK).alias("url"),
        F.when(F.expr("(conv_id + turn) % 9 = 3"), "<html>").otherwise(body).alias("body"),
    )


@query("tweet_markdown", _expected(
    "conversations", _TWEET_LINK, "fxtwitter", "fxtwitter", TWEET_ERROR,
    content=(
        "'## ' || role || ' (@u' || conv_id || ')' || chr(10) || chr(10) || text || chr(10) || chr(10) "
        f"|| repeat('![](' || {_PHOTO} || ')' || chr(10), turn % 3) "
        "|| repeat('[视频](https://v.example/' || turn || ')' || chr(10), turn % 2) "
        "|| chr(10) || '👍 ' || conv_id || '  🔄 ' || (CASE WHEN turn % 4 = 0 THEN 0 ELSE turn END) "
        f"|| '  💬 3000000000' || chr(10) || chr(10) || '[查看原推文](' || {_TWEET_URL} || ')' || chr(10)"
    ),
    url=_TWEET_URL, title="role || ' (@u' || conv_id || ')'", description="text",
    image=f"CASE WHEN turn % 3 > 0 THEN {_PHOTO} WHEN turn % 5 = 0 THEN '' ELSE '/a/' || conv_id END", author="role",
    site_name="'X (Twitter)'",
))
def tweet_markdown(spark, folder):
    return _flat(P.tweet_candidates(tweet_answers(table(spark, folder, "conversations")), max_bytes=0))


SEARCH_ERROR = (
    "CASE page_id % 7 WHEN 0 THEN 'Brave Search 无结果' WHEN 1 THEN 'Brave Search HTTP 429: slow down' "
    "WHEN 2 THEN '解析 Brave Search 响应失败' END"
)


def search_answers(pages: DataFrame) -> DataFrame:
    def result(prefix: str) -> Column:
        return F.struct(
            _named("title", f"'{prefix}' || {TITLE}"), _named("description", _present(5, "'about ' || page_id")),
            _named("url", "url || '#found'"),
            F.when(F.expr("page_id % 2 = 0"), F.struct(_named("hostname", HOST))).alias("meta_url"),
        )

    found = F.expr("CASE WHEN page_id % 7 = 0 THEN 0 ELSE 2 END")
    results = F.slice(F.array(result(""), result("second ")), F.lit(1), found)
    body = _json(F.struct(results.alias("results")).alias("web"))
    return pages.select(
        "url",
        F.when(F.expr("page_id % 7 = 1"), "slow down").when(F.expr("page_id % 7 = 2"), '{"web": []}').otherwise(body)
        .alias("body"),
        F.when(F.expr("page_id % 7 = 1"), 429).otherwise(200).alias("status"),
    )


_ABOUT = "CASE WHEN page_id % 5 = 0 THEN '' ELSE 'about ' || page_id END"


@query("search_parse", _expected(
    "pages", "url", "brave-search", "", SEARCH_ERROR, content=f"{TITLE} || chr(10) || chr(10) || {_ABOUT}",
    url="url || '#found'", title=TITLE, description=_ABOUT, site_name=_or(2, "''", HOST),
))
def search_parse(spark, folder):
    return _flat(P.search_candidates(search_answers(table(spark, folder, "pages"))))
