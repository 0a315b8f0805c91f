"""All nine methods over saved answers filed under the requested address, from the frontier back into the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import constants as C
from gleanery.catalog.cascade import _FAILURE_SQL, _PLANS_SQL
from gleanery.catalog.providers import _collapsed
from gleanery.catalog.registry import query, table, trimmed
from gleanery.functions.html import metadata_struct
from gleanery.functions.urls import url_hash
from gleanery.plans import staged as P

_MODES = list(C.ALL_MODES)
# Links to posts, of which some cannot be asked for; a site that needs rendering; anything else.
_UNKNOWN = "(doc_id % 4 = 0 AND doc_id % 3 = 2)"
_URL = (
    f"CASE WHEN {_UNKNOWN} THEN 'https://mobile.x.com/u/status/' || doc_id "
    "WHEN doc_id % 4 = 0 THEN 'https://x.com/u/status/' || doc_id || '?s=' || lang "
    "WHEN doc_id % 4 = 1 THEN 'https://juejin.cn/p/' || doc_id ELSE 'https://d.example/' || doc_id || '?a=1&b=c+d*~' END"
)
_ROUTE = "CASE doc_id % 4 WHEN 0 THEN 'twitter' WHEN 1 THEN 'stealth' ELSE 'normal' END"
# What a method has saved (m: its place in the list): good, too short, blank, an error, or, at 10, nothing.
_KIND = "(doc_id * 7 + m * 5) % 11"
_TEXT = f"CASE WHEN {_KIND} < 2 THEN text WHEN {_KIND} < 5 THEN 'short ' || doc_id ELSE ' ' END"
_PAGE_TEXT = f"CASE WHEN {_KIND} < 2 THEN repeat('word ', 30) || doc_id WHEN {_KIND} < 5 THEN 'short ' || doc_id ELSE '' END"
_STATUS = f"CASE WHEN {_KIND} >= 7 THEN 493 + {_KIND} ELSE 200 END"
_FAILED = f"'HTTP ' || (493 + {_KIND})"

_ERROR_SQL = f"""
    CASE WHEN mode = 'fxtwitter' AND {_UNKNOWN} THEN '无法识别 Twitter/X URL 格式: ' || ({_URL})
         WHEN {_KIND} >= 7 THEN CASE mode WHEN 'firecrawl' THEN 'firecrawl ' WHEN 'webpagesnap' THEN 'webpagesnap '
             WHEN 'markdown-new' THEN 'markdown.new ' WHEN 'defuddle' THEN 'Defuddle ' WHEN 'jina' THEN 'Jina '
             WHEN 'fxtwitter' THEN 'fxtwitter ' WHEN 'brave-search' THEN 'Brave Search ' ELSE '' END || {_FAILED}
         WHEN {_KIND} >= 2 AND mode = 'fxtwitter' THEN 'fxtwitter 返回失败: code=404'
         WHEN {_KIND} >= 2 AND mode = 'brave-search' THEN 'Brave Search 无结果' END"""
_CONTENT_SQL = f"""
    CASE WHEN mode IN ('http', 'stealth') THEN {_PAGE_TEXT}
         WHEN mode IN ('firecrawl', 'webpagesnap', 'markdown-new') THEN {trimmed(_TEXT)}
         WHEN mode = 'defuddle' THEN {trimmed(_collapsed(_TEXT))} WHEN mode = 'jina' THEN {_collapsed(trimmed(_TEXT))}
         WHEN mode = 'brave-search' THEN lang || chr(10) || chr(10) || text
         ELSE '## ' || lang || ' (@s)' || chr(10) || chr(10) || text || chr(10) || chr(10) || chr(10)
             || '👍 1  🔄 0  💬 0' || chr(10) || chr(10) || '[查看原推文](https://x.com/u/status/' || doc_id || ')' || chr(10) END"""
_SQL = f"""
    WITH candidates AS (
        SELECT doc_id, {_URL} AS url, {_ROUTE} AS route, mode, {_CONTENT_SQL} AS content, {_ERROR_SQL} AS error
        FROM (SELECT *, unnest({_MODES!r}) AS mode, unnest(range({len(_MODES)})) AS m FROM documents)
        WHERE {_KIND} < 10 OR mode = 'fxtwitter' AND {_UNKNOWN}),
    best AS (
        SELECT c.*, priority FROM candidates c JOIN {_PLANS_SQL} p ON c.route = p.route AND c.mode = p.mode
        WHERE error IS NULL AND (c.mode IN ('brave-search', 'fxtwitter') OR strlen(content) >= 100)
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY priority) = 1),
    {_FAILURE_SQL},
    results AS (
        SELECT d.doc_id, CASE WHEN d.doc_id % 19 = 0 THEN 'ftp://' || d.doc_id ELSE u.url END AS request_url,
            CASE WHEN d.doc_id % 19 = 0 THEN 'invalid' WHEN d.doc_id % 7 = 0 THEN 'cached' ELSE coalesce(b.mode, 'failed') END AS mode,
            CASE WHEN d.doc_id % 19 = 0 THEN '' WHEN d.doc_id % 7 = 0 THEN 'stored ' || text ELSE coalesce(b.content, '') END AS content,
            CASE WHEN d.doc_id % 19 = 0 THEN 'URL 校验失败: 不支持协议: ftp（仅支持 http/https）'
                 WHEN d.doc_id % 7 = 0 OR b.url IS NOT NULL THEN NULL ELSE x.error END AS error
        FROM documents d JOIN (SELECT doc_id, {_URL} AS url FROM documents) u ON d.doc_id = u.doc_id
            LEFT JOIN best b ON d.doc_id = b.doc_id LEFT JOIN failures x ON u.url = x.url)
    SELECT request_url, mode, strlen(content)::BIGINT AS content_length, sha256(content) AS content_sha256, error,
        CASE WHEN error IS NULL THEN sha256(content) END AS in_store_sha256 FROM results"""


def _json(**fields: Column | str) -> Column:
    return F.to_json(F.struct(*[(F.expr(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()]))


def planted_answers(documents: DataFrame, mode: str) -> DataFrame:
    """Saved answers of one method: ``request_url, html, error, body, status``."""
    rows = documents.select("doc_id", "text", "lang", F.expr(_URL).alias("url"), F.lit(_MODES.index(mode)).alias("m"))
    rows = rows.where(f"{_KIND} < 10").withColumn("said", F.expr(_TEXT))
    scrape = _json(success="true", data=F.struct(F.col("said").alias("markdown")))
    snapshot = _json(success="true", body="said")
    first = F.struct(F.col("lang").alias("title"), F.col("text").alias("description"), F.col("url"))
    search = _json(web=F.struct(F.when(F.expr(f"{_KIND} < 2"), F.array(first)).otherwise(F.array()).alias("results")))
    post = _json(
        code=f"CASE WHEN {_KIND} < 2 THEN 200 ELSE 404 END",
        tweet=F.struct(F.expr("'https://x.com/u/status/' || doc_id").alias("url"), "text", F.lit(1).alias("likes"),
                       F.struct(F.col("lang").alias("name"), F.lit("s").alias("screen_name")).alias("author")))
    made = {C.MODE_FIRECRAWL: scrape, C.MODE_WEBPAGESNAP: snapshot, C.MODE_BRAVE: search, C.MODE_FXTWITTER: post}
    html = F.concat(F.lit("<html><body><article><p>"), F.expr(_PAGE_TEXT), F.lit("</p></article></body></html>"))
    return rows.select(
        P.request_address(mode, "url").alias("request_url"), html.alias("html"),
        F.expr(f"CASE WHEN {_KIND} >= 7 THEN {_FAILED} END").alias("error"),
        made.get(mode, F.col("said")).alias("body"), F.expr(_STATUS).alias("status"))


def answer_tables(documents: DataFrame) -> dict[str, DataFrame]:
    saved = {m: planted_answers(documents, m) for m in _MODES}
    pages = {m: saved[m].select("request_url", "html", "error") for m in (C.MODE_HTTP, C.MODE_STEALTH)}
    return {m: saved[m].select("request_url", "body", "status") for m in _MODES} | pages


def fetched(spark, folder) -> P.Fetched:
    documents = table(spark, folder, "documents")
    url = F.expr(_URL)
    store = documents.where("doc_id % 7 = 0").select(
        url_hash(url).alias("url_hash"), url.alias("url"), F.concat(F.lit("stored "), "text").alias("content"),
        metadata_struct(title=F.lit("kept")).alias("metadata"), F.lit("2024-01-30 00:00:00").cast("timestamp").alias("created_at"))
    frontier = documents.select(F.expr(f"CASE WHEN doc_id % 19 = 0 THEN 'ftp://' || doc_id ELSE {_URL} END").alias("url"))
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return P.fetch_staged(frontier, answer_tables(documents), store, as_of)


@query("fetch_cascade", _SQL)
def fetch_cascade(spark, folder):
    """Results of every document's URL by route, each with what the store then holds of it."""
    results, store, _ = fetched(spark, folder)
    kept = store.select(F.col("url").alias("request_url"), F.sha2("content", 256).alias("in_store_sha256"))
    about = results.select("request_url", "mode", "content_length", F.sha2("content", 256).alias("content_sha256"), "error")
    return about.join(kept, "request_url", "left")
