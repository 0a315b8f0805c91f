"""URL rules on planted variants of every page URL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery import constants as C
from gleanery.catalog.registry import query, table
from gleanery.functions import urls as U

HOST = "regexp_extract(url, '^https?://([^/:?#]+)', 1)"
REST = "substr(url, instr(url, '://') + 3)"

_SCHEME = "'不支持协议: {}（仅支持 http/https）'"
_PARSE = "'URL 格式错误: parse \"' || {url} || '\": {why}'"


def _parse(url: str, why: str) -> str:
    return _PARSE.format(url=url, why=why)


# (planted URL, expected error, expected domain), each as SQL.
_VARIANTS = [
    ("''", "'URL 不能为空'", "''"),
    ("'   '", _SCHEME.format(""), "''"),
    (f"'ftp://' || {REST}", _SCHEME.format("ftp"), HOST),
    ("'http://'", "'域名不能为空'", "''"),
    (REST, _SCHEME.format(""), "''"),
    ("'  ' || url || '  '", "NULL", "''"),
    (f"'HTTPS://' || {REST}", "NULL", HOST),
    (f"'https://' || {HOST} || ':8443/x'", "NULL", HOST),
    (f"'http://user:pa-ss@' || {REST}", "NULL", HOST),
    ("'http://[2001:db8::' || page_id || ']:8080/x'", "NULL", "'2001:db8::' || page_id"),
    ("'http://[::1/x'", _parse("'http://[::1/x'", "missing '']'' in host"), "''"),
    (f"'http://my_' || {REST}", "NULL", f"'my_' || {HOST}"),
    (f"'http://' || {HOST} || ':8x/'",
     _parse(f"'http://' || {HOST} || ':8x/'", 'invalid port ":8x" after host'), "''"),
    (f"'http://' || {HOST} || '/%zz'",
     _parse(f"'http://' || {HOST} || '/%zz'", 'invalid URL escape "%zz"'), "''"),
    ("'http://a b/'", _parse("'http://a b/'", 'invalid character " " in host name'), "''"),
    ("'http://:80/'", "NULL", "''"),
    (f"'mailto:x@' || {HOST}", _SCHEME.format("mailto"), "''"),
    (f"':' || {REST}", _parse(f"split_part(':' || {REST}, '#', 1)", "missing protocol scheme"), "''"),
    (f"'https://' || {HOST} || '/q?x=%zz'", "NULL", HOST),
]


def _case(column: int, otherwise: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {row[column]}" for i, row in enumerate(_VARIANTS))
    return f"CASE page_id % 25 {whens} ELSE {otherwise} END"


@query("url_validation", f"""
    SELECT page_id, {_case(0, 'url')} AS url, {_case(1, 'NULL')} AS error,
           ({_case(1, 'NULL')}) IS NULL AS valid
    FROM pages""")
def url_validation(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", F.expr(_case(0, "url")).alias("url"))
    return pages.withColumn("error", U.url_error("url")).withColumn("valid", F.col("error").isNull())


@query("url_domain", f"""
    SELECT page_id, {_case(2, HOST)} AS domain FROM pages""")
def url_domain(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", F.expr(_case(0, "url")).alias("url"))
    return pages.select("page_id", U.url_domain("url").alias("domain"))


@query("url_hash", "SELECT page_id, substr(sha256(url), 1, 16) AS url_hash FROM pages")
def url_hash(spark, folder):
    return table(spark, folder, "pages").select("page_id", U.url_hash("url").alias("url_hash"))


# (host, twitter?, stealth?); the page's own host otherwise.
_HOSTS = [
    ("x.com", True, False), ("www.twitter.com", True, False), ("mobile.x.com", True, False),
    ("fxtwitter.com", False, False), ("juejin.cn", False, True), ("a.juejin.cn", False, True),
    ("notx.com", False, False), ("mp.weixin.qq.com", False, True), ("zhuanlan.zhihu.com", False, True),
    ("mp.toutiao.com", False, True), ("zhihu.com", False, False),
]
HOST_URL = (
    "CASE page_id % 16 " + " ".join(f"WHEN {i} THEN 'https://{h[0]}/p/' || page_id" for i, h in enumerate(_HOSTS))
    + " ELSE url END"
)
IS_TWITTER = "page_id % 16 IN (" + ", ".join(str(i) for i, h in enumerate(_HOSTS) if h[1]) + ")"
IS_STEALTH = "page_id % 16 IN (" + ", ".join(str(i) for i, h in enumerate(_HOSTS) if h[2]) + ")"
HOST_OF_URL = (
    "CASE page_id % 16 " + " ".join(f"WHEN {i} THEN '{h[0]}'" for i, h in enumerate(_HOSTS)) + f" ELSE {HOST} END"
)
ROUTE = f"CASE WHEN {IS_TWITTER} THEN 'twitter' WHEN {IS_STEALTH} THEN 'stealth' ELSE 'normal' END"


@query("route_class", f"""
    SELECT page_id, {IS_TWITTER} AS is_twitter, {IS_STEALTH} AS is_stealth, {ROUTE} AS route,
           CASE WHEN {IS_TWITTER} THEN 'twitter' ELSE 'normal' END AS route_without_browser,
           CASE WHEN {IS_TWITTER} THEN 'twitter' ELSE 'stealth' END AS route_forced
    FROM pages""")
def route_class(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", U.url_domain(F.expr(HOST_URL)).alias("domain"))
    return pages.select(
        "page_id", U.is_twitter("domain").alias("is_twitter"), U.is_stealth("domain").alias("is_stealth"),
        U.route_class("domain").alias("route"),
        U.route_class("domain", has_browser=False).alias("route_without_browser"),
        U.route_class("domain", force_stealth=True).alias("route_forced"),
    )


_TWEETS = [
    "'https://twitter.com/u/status/' || page_id", "' https://x.com/u/status/' || page_id || '?s=20 '",
    "'https://fxtwitter.com/u/' || page_id", "'https://fixupx.com/u/' || page_id || '#top'",
    "'http://x.com/u/status/' || page_id", "'https://www.twitter.com/u/' || page_id",
]
TWEET_URL = "CASE page_id % 8 " + " ".join(f"WHEN {i} THEN {u}" for i, u in enumerate(_TWEETS)) + " ELSE url END"


@query("tweet_api_url", """
    SELECT page_id, CASE page_id % 8
        WHEN 0 THEN 'https://api.fxtwitter.com/u/status/' || page_id
        WHEN 1 THEN 'https://api.fxtwitter.com/u/status/' || page_id
        WHEN 2 THEN 'https://api.fxtwitter.com/u/' || page_id
        WHEN 3 THEN 'https://api.fxtwitter.com/u/' || page_id || '#top'
        ELSE '' END AS api_url
    FROM pages""")
def tweet_api_url(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.select("page_id", U.tweet_api_url(F.expr(TWEET_URL)).alias("api_url"))


@query("provider_urls", """
    SELECT page_id, 'https://r.jina.ai/' || url AS jina, 'https://defuddle.md/' || url AS defuddle,
           'https://markdown.new/' || url AS markdown_new,
           'https://webpagesnap.com/api/scrape?url=' || url AS webpagesnap,
           'https://api.search.brave.com/res/v1/web/search?q='
               || replace(url_encode(url || ' ~*é'), '%20', '+') || '&count=5' AS brave,
           'https://api.firecrawl.dev/v1/scrape' AS firecrawl
    FROM pages""")
def provider_urls(spark, folder):
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id",
        U.provider_request_url(C.MODE_JINA, url).alias("jina"),
        U.provider_request_url(C.MODE_DEFUDDLE, url).alias("defuddle"),
        U.provider_request_url(C.MODE_MARKDOWN_NEW, url).alias("markdown_new"),
        U.provider_request_url(C.MODE_WEBPAGESNAP, url).alias("webpagesnap"),
        U.provider_request_url(C.MODE_BRAVE, F.concat(url, F.lit(" ~*é"))).alias("brave"),
        U.provider_request_url(C.MODE_FIRECRAWL, url).alias("firecrawl"),
    )
