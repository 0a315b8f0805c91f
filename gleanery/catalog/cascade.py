"""Choosing results: plans, best candidates, failures, attempts and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery import constants as C
from gleanery.catalog.registry import query, table
from gleanery.catalog.urls import HOST_URL, ROUTE
from gleanery.functions.html import metadata_struct
from gleanery.operators import cascade as K
from gleanery.plans.fetch import batch_fetch as answer_batches
from gleanery.plans.fetch import fetch_results as results_of

_NORMAL = ["http", "stealth", "firecrawl", "webpagesnap", "markdown-new", "defuddle", "jina", "brave-search"]
_PLANS_SQL = f"""
    (SELECT route, unnest(modes) AS mode, generate_subscripts(modes, 1) AS priority FROM (VALUES
        ('normal', {_NORMAL!r}),
        ('stealth', {_NORMAL[1:]!r}),
        ('twitter', {['fxtwitter', *_NORMAL[1:]]!r})) AS v(route, modes))"""


@query("route_plan", f"""
    SELECT page_id, f.route, CAST(priority AS INTEGER) AS priority, mode
    FROM (SELECT page_id, {ROUTE} AS route FROM pages) f JOIN {_PLANS_SQL} p ON f.route = p.route""")
def route_plan(spark, folder):
    frontier = table(spark, folder, "pages").select("page_id", F.expr(HOST_URL).alias("url"))
    return K.plan_routes(frontier).drop("url")


@query("route_plan_without_options", f"""
    SELECT page_id, f.route, mode FROM (
        SELECT page_id, CASE WHEN ({ROUTE}) = 'twitter' THEN 'twitter' ELSE 'normal' END AS route FROM pages) f
    JOIN {_PLANS_SQL} p ON f.route = p.route WHERE mode NOT IN ('stealth', 'firecrawl', 'brave-search')""")
def route_plan_without_options(spark, folder):
    frontier = table(spark, folder, "pages").select("page_id", F.expr(HOST_URL).alias("url"))
    available = [m for m in C.ALL_MODES if m not in C.OPTIONAL_MODES]
    return K.plan_routes(frontier, available=available).select("page_id", "route", "mode")


# Nine candidates per document: the text is whole, short, blank or missing depending on document and mode.
_MODES = list(C.ALL_MODES)
_URL = (
    "CASE doc_id % 4 WHEN 0 THEN 'https://x.com/' || doc_id WHEN 1 THEN 'https://juejin.cn/' || doc_id "
    "ELSE 'https://d.example/' || doc_id END"
)
_ROUTE = "CASE doc_id % 4 WHEN 0 THEN 'twitter' WHEN 1 THEN 'stealth' ELSE 'normal' END"
_KIND = "(doc_id * 7 + m * 5) % 11"  # m: place of the mode in the list, from 0
_CONTENT = f"CASE WHEN {_KIND} < 2 THEN text WHEN {_KIND} < 5 THEN substr(text, 1, 40) WHEN {_KIND} < 7 THEN ' ' ELSE '' END"
_ERROR = f"CASE WHEN {_KIND} >= 7 THEN mode || ' HTTP 50' || ({_KIND} - 7) END"
_TYPE = "CASE WHEN doc_id % 3 = 0 THEN 'text/plain' ELSE 'text/html; charset=utf-8' END"

_CANDIDATES_SQL = f"""
    SELECT doc_id, {_URL} AS url, {_ROUTE} AS route, mode, {_CONTENT} AS content, {_ERROR} AS error, {_TYPE} AS type,
           lang
    FROM (SELECT *, unnest({_MODES!r}) AS mode, unnest(range({len(_MODES)})) AS m FROM documents)"""
_RANKED_SQL = f"""
    candidates AS ({_CANDIDATES_SQL}),
    ranked AS (
        SELECT c.*, priority, c.error IS NULL AND CASE
            WHEN c.mode = 'brave-search' THEN true
            WHEN c.mode = 'fxtwitter' THEN strlen(trim(content)) > 0
            WHEN c.mode = 'http' AND type = 'text/plain' THEN strlen(trim(content)) >= 3
            ELSE strlen(content) >= 100 END AS valid
        FROM candidates c LEFT JOIN {_PLANS_SQL} p ON c.route = p.route AND c.mode = p.mode),
    best AS (
        SELECT * FROM ranked WHERE valid AND priority IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY priority) = 1)"""


def _shown(mode: str) -> str:
    return f"coalesce(max(error) FILTER (mode = '{mode}'), '<nil>')"


_TAIL = (f"', webpagesnap=' || {_shown('webpagesnap')} || ', markdownnew=' || {_shown('markdown-new')} "
         f"|| ', defuddle=' || {_shown('defuddle')} || ', jina=' || {_shown('jina')}")
_FAILURE_SQL = f"""
    failures AS (
        SELECT url, 'all methods failed: ' || CASE any_value(route)
            WHEN 'normal' THEN 'http=' || {_shown('http')}
            WHEN 'stealth' THEN 'browser=' || {_shown('stealth')} || ', firecrawl=skipped'
            ELSE 'fxtwitter=' || {_shown('fxtwitter')} || ', browser=' END || {_TAIL} AS error
        FROM candidates GROUP BY url)"""


def planted_candidates(documents: DataFrame) -> DataFrame:
    modes = F.array(*[F.lit(m) for m in _MODES])
    rows = documents.select("doc_id", "text", "lang", F.posexplode(modes).alias("m", "mode"))
    return rows.select(
        F.expr(_URL).alias("url"), "mode", F.expr(_CONTENT).alias("content"), F.expr(_TYPE).alias("content_type"),
        F.concat(F.lit("s-"), "mode").alias("selector"),
        metadata_struct(url=F.expr(f"{_URL} || '#c'"), title="lang").alias("metadata"), F.expr(_ERROR).alias("error"),
    )


@query("best_candidate", f"""
    WITH {_RANKED_SQL}
    SELECT url AS request_url, mode, content, 's-' || mode AS selector, url || '#c' AS url, lang AS title FROM best""")
def best_candidate(spark, folder):
    best = K.select_best(planted_candidates(table(spark, folder, "documents")))
    return best.where("success").select(
        "request_url", "mode", "content", "selector", "metadata.url", "metadata.title")


@query("cascade_failures", f"""
    WITH {_RANKED_SQL}, {_FAILURE_SQL}
    SELECT url AS request_url, 'failed' AS mode, error, url FROM failures WHERE url NOT IN (SELECT url FROM best)""")
def cascade_failures(spark, folder):
    best = K.select_best(planted_candidates(table(spark, folder, "documents")))
    return best.where("NOT success").select("request_url", "mode", "error", "metadata.url")


@query("attempt_resolution", """
    WITH attempts AS (
        SELECT event_id // 3 AS task, event_id % 3 + 1 AS attempt, event_id, value,
               CASE WHEN event_type IN ('error', 'click') THEN 'e' || event_id END AS error FROM events)
    SELECT task, bool_or(error IS NULL) AS ok, min(attempt) FILTER (error IS NULL) AS ok_attempt,
           min_by(value, attempt) FILTER (error IS NULL) AS value,
           CASE WHEN NOT bool_or(error IS NULL) THEN max_by(error, attempt) END AS error
    FROM attempts WHERE attempt <= 2 GROUP BY task""")
def attempt_resolution(spark, folder):
    attempts = table(spark, folder, "events").select(
        F.expr("CAST(event_id DIV 3 AS BIGINT)").alias("task"), (F.col("event_id") % 3 + 1).alias("attempt"), "value",
        F.expr("CASE WHEN event_type IN ('error', 'click') THEN 'e' || event_id END").alias("error"),
    )
    return K.resolve_attempts(attempts, ["task"], payload=["value"], max_attempts=C.BROWSER_ATTEMPTS)


# Frontier: every document's URL, some of them invalid; every seventh one is in the store.
_ASKED = f"CASE WHEN doc_id % 19 = 0 THEN 'ftp://' || doc_id ELSE {_URL} END"
_RESULTS_SQL = f"""
    WITH {_RANKED_SQL}, {_FAILURE_SQL},
    frontier AS (SELECT DISTINCT doc_id, {_ASKED} AS url, text FROM documents),
    results AS (
        SELECT f.doc_id, f.url AS request_url,
               CASE WHEN f.doc_id % 19 = 0 OR f.doc_id % 7 = 0 OR b.url IS NULL THEN f.url ELSE f.url || '#c' END AS url,
               CASE WHEN f.doc_id % 19 = 0 THEN 'invalid' WHEN f.doc_id % 7 = 0 THEN 'cached'
                    ELSE coalesce(b.mode, 'failed') END AS mode,
               CASE WHEN f.doc_id % 19 = 0 THEN '' WHEN f.doc_id % 7 = 0 THEN 'stored ' || f.text
                    ELSE coalesce(b.content, '') END AS content,
               CASE WHEN f.doc_id % 19 <> 0 AND f.doc_id % 7 <> 0 THEN 's-' || b.mode END AS selector_matched,
               CASE WHEN f.doc_id % 19 = 0 THEN 'URL 校验失败: 不支持协议: ftp（仅支持 http/https）'
                    WHEN f.doc_id % 7 = 0 OR b.url IS NOT NULL THEN NULL ELSE x.error END AS error
        FROM frontier f LEFT JOIN best b ON f.url = b.url LEFT JOIN failures x ON f.url = x.url)"""


def _results(spark, folder) -> DataFrame:
    documents = table(spark, folder, "documents")
    store = documents.where("doc_id % 7 = 0").select(
        F.expr(f"substring(sha2({_URL}, 256), 1, 16)").alias("url_hash"), F.expr(_URL).alias("url"),
        F.concat(F.lit("stored "), "text").alias("content"), metadata_struct(title=F.lit("kept")).alias("metadata"),
        F.lit("2024-01-30 00:00:00").cast("timestamp").alias("created_at"),
    )
    frontier = documents.select(F.expr(_ASKED).alias("url"))
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return results_of(frontier, planted_candidates(documents), store, as_of)


@query("fetch_results", f"""
    {_RESULTS_SQL}
    SELECT request_url, url, mode, content, CAST(strlen(content) AS BIGINT) AS content_length, selector_matched,
           error IS NULL AS success, error FROM results""")
def fetch_results(spark, folder):
    return _results(spark, folder).select(
        "request_url", "url", "mode", "content", "content_length", "selector_matched", "success", "error")


def _answered(spark, folder, max_urls: int | None = None) -> DataFrame:
    requests = table(spark, folder, "documents").groupBy(F.expr("CAST(doc_id DIV 25 AS BIGINT)").alias("batch_id")).agg(
        F.sort_array(F.collect_list(F.struct("doc_id", F.expr(_ASKED).alias("url")))).alias("rows")
    ).select("batch_id", F.transform("rows", lambda r: r["url"]).alias("urls"))
    answers = answer_batches(requests, _results(spark, folder), max_urls=max_urls)
    item = "url STRING, success BOOLEAN, error STRING, content_length BIGINT"
    parsed = answers.select("batch_id", F.from_json("json", f"code INT, message STRING, data ARRAY<STRUCT<{item}>>").alias("a"))
    return parsed.select("batch_id", "a.code", "a.message", F.posexplode_outer("a.data").alias("pos", "item")).select(
        "batch_id", "pos", "item.url", "item.success",
        F.coalesce("item.error", F.when(F.col("code") == 400, F.col("message"))).alias("error"), "item.content_length",
    )


@query("batch_fetch", f"""
    {_RESULTS_SQL},
    items AS (SELECT doc_id // 25 AS batch_id, doc_id, doc_id % 25 AS pos FROM documents)
    SELECT batch_id, CAST(pos AS INTEGER) AS pos, r.url AS url, error IS NULL AS success, r.error,
           CASE WHEN error IS NULL THEN strlen(content) END AS content_length
    FROM items i JOIN results r ON i.doc_id = r.doc_id
    WHERE (SELECT count(*) FROM items j WHERE j.batch_id = i.batch_id) <= 20
    UNION ALL
    SELECT batch_id, NULL, NULL, NULL, '最多支持 20 个 URL', NULL FROM items GROUP BY batch_id HAVING count(*) > 20""")
def batch_fetch(spark, folder):
    """Requests of up to 25 URLs (over 20 are refused), read back from the JSON answers."""
    return _answered(spark, folder, C.MAX_BATCH_URLS)


@query("batch_fetch_whole", f"""
    {_RESULTS_SQL}
    SELECT doc_id // 25 AS batch_id, CAST(doc_id % 25 AS INTEGER) AS pos, url, error IS NULL AS success, error,
           CASE WHEN error IS NULL THEN strlen(content) END AS content_length
    FROM results""")
def batch_fetch_whole(spark, folder):
    """The same requests without a limit: one answer for every document."""
    return _answered(spark, folder)
