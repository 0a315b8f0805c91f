"""Saved answers of reader services as candidate rows.

Every function takes ``url, body`` (and optionally ``status``) and returns the candidate columns
``url, mode, content, content_type, selector, metadata, error``.  All are projections: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery import constants as C
from gleanery.functions.html import frontmatter_metadata, metadata_struct, parse_frontmatter
from gleanery.functions.text import (
    collapse_newlines, non_empty, or_empty, sanitize_text, trim_space, truncate_bytes, truncate_chars,
)
from gleanery.functions.urls import tweet_api_url, url_domain
from gleanery.operators.extract import extract_content
from gleanery.schemas import CANDIDATE_COLUMNS, PROVIDER_SCHEMAS

_CORRUPT = "_corrupt"


def parse_provider(mode: str, body: Column) -> Column:
    """A service's JSON as a struct; its ``_corrupt`` field is non-null when the text does not fit the schema."""
    schema = T.StructType([*PROVIDER_SCHEMAS[mode].fields, T.StructField(_CORRUPT, T.StringType())])
    return F.from_json(or_empty(body), schema, {"columnNameOfCorruptRecord": _CORRUPT})


def _http_problem(df: DataFrame, label: str, with_body: int | None = None) -> Column:
    if "status" not in df.columns:
        return F.lit(None).cast("string")
    text = F.concat(F.lit(f"{label} HTTP "), F.col("status").cast("string"))
    if with_body is not None:
        shown = truncate_chars(or_empty(F.col("body")), with_body) if with_body else or_empty(F.col("body"))
        text = F.concat(text, F.lit(": "), shown)
    return F.when(F.col("status") != 200, text)


def _unreadable(parsed: Column, message: str) -> Column:
    return F.when(parsed.isNull() | parsed[_CORRUPT].isNotNull(), F.lit(message))


def _candidates(df: DataFrame, mode: str, content: Column, metadata: Column, error: Column,
                content_type: str = "text/html") -> DataFrame:
    ok = F.col("_error").isNull()
    return df.withColumn("_error", error).select(
        "url",
        F.lit(mode).alias("mode"),
        F.when(ok, content).otherwise("").alias("content"),
        F.lit(content_type).alias("content_type"),
        F.when(ok, C.SELECTOR_OF_MODE[mode]).otherwise("").alias("selector"),
        F.when(ok, metadata).otherwise(metadata_struct()).alias("metadata"),
        F.col("_error").alias("error"),
    )


def _page_candidates(pages: DataFrame, mode: str, content_type: Column, max_bytes: int, bare_text: bool) -> DataFrame:
    error = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    slim = pages.select("url", "html", content_type.alias("content_type"), error.alias("error"))
    return extract_content(slim, max_bytes=max_bytes, bare_text=bare_text).select(
        "url", F.lit(mode).alias("mode"), "content", "content_type", "selector", "metadata", "error"
    )


def http_candidates(pages: DataFrame, max_bytes: int = 0, bare_text: bool = True) -> DataFrame:
    """Pages as saved from plain HTTP; ``content_type`` and ``error`` columns are optional."""
    kind = F.col("content_type") if "content_type" in pages.columns else F.lit("text/html")
    return _page_candidates(pages, C.MODE_HTTP, kind, max_bytes, bare_text)


def rendered_candidates(pages: DataFrame, max_bytes: int = 0, bare_text: bool = True) -> DataFrame:
    """Pages as rendered by a browser; always judged as HTML."""
    return _page_candidates(pages, C.MODE_STEALTH, F.lit("text/html"), max_bytes, bare_text)


def firecrawl_candidates(df: DataFrame, max_bytes: int = 0) -> DataFrame:
    df = df.withColumn("_json", parse_provider(C.MODE_FIRECRAWL, F.col("body")))
    json, page = F.col("_json"), F.col("_json.data.metadata")
    success = F.coalesce(json["success"], F.lit(False))
    error = F.coalesce(
        _http_problem(df, "firecrawl", with_body=200),
        _unreadable(json, "firecrawl 解析 JSON 失败"),
        F.when(~success | (or_empty(json["data"]["markdown"]) == ""),
               F.concat(F.lit("firecrawl 返回失败: success="), success.cast("string"))),
    )
    metadata = metadata_struct(
        url=F.coalesce(non_empty(page["sourceURL"]), F.col("url")),
        title=F.coalesce(non_empty(page["title"]), page["ogTitle"]),
        description=F.coalesce(non_empty(page["description"]), page["ogDescription"]),
        image=page["ogImage"],
        author=page["author"],
        site_name=url_domain("url"),
    )
    content = truncate_bytes(trim_space(json["data"]["markdown"]), max_bytes)
    return _candidates(df, C.MODE_FIRECRAWL, content, metadata, error)


def webpagesnap_candidates(df: DataFrame, max_bytes: int = 0) -> DataFrame:
    df = df.withColumn("_json", parse_provider(C.MODE_WEBPAGESNAP, F.col("body")))
    json, head = F.col("_json"), F.col("_json.header")
    success = F.coalesce(json["success"], F.lit(False))
    error = F.coalesce(
        _http_problem(df, "webpagesnap"),
        _unreadable(json, "webpagesnap 解析 JSON 失败"),
        F.when(~success | (or_empty(json["body"]) == ""),
               F.concat(F.lit("webpagesnap 返回失败: success="), success.cast("string"), F.lit(", body 为空"))),
    )
    metadata = metadata_struct(
        url=F.coalesce(non_empty(json["finalUrl"]), F.col("url")),
        title=sanitize_text(F.coalesce(non_empty(head["ogTitle"]), head["title"])),
        description=sanitize_text(F.coalesce(non_empty(head["ogDescription"]), head["description"])),
        image=F.coalesce(non_empty(head["ogImage"]), head["twitterImage"]),
        author=head["author"],
        site_name=url_domain("url"),
    )
    content = truncate_bytes(trim_space(json["body"]), max_bytes)
    return _candidates(df, C.MODE_WEBPAGESNAP, content, metadata, error)


def markdownnew_candidates(df: DataFrame, max_bytes: int = 0) -> DataFrame:
    """Front matter is read before the cut, so a cut can never hide its end mark."""
    df = df.withColumn("_split", parse_frontmatter(trim_space(or_empty(F.col("body")))))
    meta = F.col("_split.meta")
    metadata = metadata_struct(
        url="url",
        title=F.try_element_at(meta, F.lit("title")),
        description=F.try_element_at(meta, F.lit("description")),
        site_name=url_domain("url"),
    )
    content = truncate_bytes(F.col("_split.body"), max_bytes)
    return _candidates(df, C.MODE_MARKDOWN_NEW, content, metadata, _http_problem(df, "markdown.new"))


def defuddle_candidates(df: DataFrame) -> DataFrame:
    df = df.withColumn("_split", parse_frontmatter(or_empty(F.col("body"))))
    content = trim_space(collapse_newlines(F.col("_split.body")))
    metadata = frontmatter_metadata("_split.meta", "url")
    return _candidates(df, C.MODE_DEFUDDLE, content, metadata, _http_problem(df, "Defuddle"))


def jina_candidates(df: DataFrame) -> DataFrame:
    content = collapse_newlines(trim_space(or_empty(F.col("body"))))
    return _candidates(df, C.MODE_JINA, content, metadata_struct(url="url"), _http_problem(df, "Jina"))


def tweet_candidates(df: DataFrame, max_bytes: int = 0) -> DataFrame:
    df = df.withColumn("_json", parse_provider(C.MODE_FXTWITTER, F.col("body")))
    json, tweet = F.col("_json"), F.col("_json.tweet")
    code = F.coalesce(json["code"], F.lit(0))
    error = F.coalesce(
        F.when(tweet_api_url("url") == "", F.concat(F.lit(C.MSG_TWEET_URL), F.col("url"))),
        _http_problem(df, "fxtwitter"),
        _unreadable(json, "fxtwitter 解析 JSON 失败"),
        F.when((code != 200) | (or_empty(tweet["text"]) == ""),
               F.concat(F.lit("fxtwitter 返回失败: code="), code.cast("string"))),
    )
    name, screen = or_empty(tweet["author"]["name"]), or_empty(tweet["author"]["screen_name"])
    byline = F.concat(name, F.lit(" (@"), screen, F.lit(")"))

    def links(items: Column, label: str) -> Column:
        lines = F.transform(items, lambda item: F.concat(F.lit(f"{label}("), or_empty(item["url"]), F.lit(")\n")))
        return or_empty(F.array_join(lines, ""))

    def number(name: str) -> Column:
        return F.coalesce(tweet[name], F.lit(0))

    content = F.concat(
        F.lit("## "), byline, F.lit("\n\n"), tweet["text"], F.lit("\n\n"),
        links(tweet["media"]["photos"], "![]"),
        links(tweet["media"]["videos"], f"[{C.TWEET_VIDEO_LABEL}]"),
        F.format_string(C.TWEET_COUNTER_FORMAT, number("likes"), number("retweets"), number("replies")),
        F.lit(f"\n[{C.TWEET_LINK_LABEL}]("), or_empty(tweet["url"]), F.lit(")\n"),
    )
    photos = tweet["media"]["photos"]
    metadata = metadata_struct(
        url=tweet["url"],
        title=byline,
        description=tweet["text"],
        image=F.when(F.size(photos) > 0, F.get(photos, F.lit(0))["url"]).otherwise(tweet["author"]["avatar_url"]),
        author=name,
        site_name=F.lit(C.TWEET_SITE_NAME),
    )
    return _candidates(df, C.MODE_FXTWITTER, truncate_bytes(content, max_bytes), metadata, error, "application/json")


def search_candidates(df: DataFrame, max_bytes: int = 0) -> DataFrame:
    df = df.withColumn("_json", parse_provider(C.MODE_BRAVE, F.col("body")))
    results = F.col("_json.web.results")
    first = F.get(results, F.lit(0))
    error = F.coalesce(
        _http_problem(df, "Brave Search", with_body=0),
        _unreadable(F.col("_json"), C.MSG_SEARCH_JSON),
        F.when(F.coalesce(F.size(results), F.lit(0)) <= 0, C.MSG_SEARCH_EMPTY),
    )
    title, text = or_empty(first["title"]), or_empty(first["description"])
    metadata = metadata_struct(url=first["url"], title=title, description=text, site_name=first["meta_url"]["hostname"])
    content = truncate_bytes(F.concat(title, F.lit("\n\n"), text), max_bytes)
    return _candidates(df, C.MODE_BRAVE, content, metadata, error)


NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    C.MODE_FIRECRAWL: firecrawl_candidates,
    C.MODE_WEBPAGESNAP: webpagesnap_candidates,
    C.MODE_MARKDOWN_NEW: markdownnew_candidates,
    C.MODE_DEFUDDLE: defuddle_candidates,
    C.MODE_JINA: jina_candidates,
    C.MODE_FXTWITTER: tweet_candidates,
    C.MODE_BRAVE: search_candidates,
}


def union_candidates(*frames: DataFrame) -> DataFrame:
    """One table of candidates from any of the functions above."""
    whole = frames[0].select(*CANDIDATE_COLUMNS)
    for frame in frames[1:]:
        whole = whole.unionByName(frame.select(*CANDIDATE_COLUMNS))
    return whole
