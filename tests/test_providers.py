import json

import pytest

from gleanery import constants as C
from gleanery.operators import providers as P
from gleanery.schemas import CANDIDATE_COLUMNS

URL = "https://x.com/u/status/1"


def _run(spark, normalize, body, status=None, url=URL, **options):
    text = body if body is None or isinstance(body, str) else json.dumps(body, ensure_ascii=False)
    rows = spark.createDataFrame([(url, text, status)], "url string, body string, status int")
    frame = normalize(rows if status is not None else rows.drop("status"), **options)
    assert tuple(frame.columns) == CANDIDATE_COLUMNS
    return frame.first()


def _meta(row):
    return {k: v for k, v in row["metadata"].asDict().items() if v}


@pytest.mark.parametrize("mode, body, status, error", [
    ("firecrawl", {"success": True, "data": {"markdown": "x"}}, 503,
     'firecrawl HTTP 503: {"success": true, "data": {"markdown": "x"}}'),
    ("firecrawl", "x" * 300, 500, "firecrawl HTTP 500: " + "x" * 200 + "..."),
    ("firecrawl", "", None, "firecrawl 解析 JSON 失败"),
    ("firecrawl", None, None, "firecrawl 解析 JSON 失败"),
    ("firecrawl", {"success": "yes"}, None, "firecrawl 解析 JSON 失败"),
    ("firecrawl", {}, None, "firecrawl 返回失败: success=false"),
    ("webpagesnap", {"success": True, "body": ""}, None, "webpagesnap 返回失败: success=true, body 为空"),
    ("webpagesnap", "[", None, "webpagesnap 解析 JSON 失败"),
    ("markdown-new", "x", 404, "markdown.new HTTP 404"),
    ("defuddle", "x", 404, "Defuddle HTTP 404"),
    ("jina", "x", 404, "Jina HTTP 404"),
    ("fxtwitter", {"code": 404, "tweet": {"text": "x"}}, None, "fxtwitter 返回失败: code=404"),
    ("fxtwitter", {}, None, "fxtwitter 返回失败: code=0"),
    ("fxtwitter", "no", None, "fxtwitter 解析 JSON 失败"),
    ("fxtwitter", "no", 500, "fxtwitter HTTP 500"),
    ("brave-search", {"web": {"results": []}}, None, "Brave Search 无结果"),
    ("brave-search", {}, None, "Brave Search 无结果"),
    ("brave-search", "no", None, "解析 Brave Search 响应失败"),
    ("brave-search", "no", 401, "Brave Search HTTP 401: no"),
])
def test_errors(spark, mode, body, status, error):
    row = _run(spark, P.NORMALIZERS[mode], body, status)
    assert (row["error"], row["content"], row["selector"], _meta(row)) == (error, "", "", {})


def test_unusable_tweet_link(spark):
    row = _run(spark, P.tweet_candidates, {"code": 200, "tweet": {"text": "t"}}, url="http://x.com/u")
    assert row["error"] == C.MSG_TWEET_URL + "http://x.com/u"


def test_scrape_fallbacks(spark):
    body = {"success": True, "data": {"markdown": " 中文 ", "metadata": {"ogTitle": "T", "description": "d"}}}
    row = _run(spark, P.firecrawl_candidates, body, max_bytes=4)
    assert (row["content"], row["error"]) == ("中", None)
    assert _meta(row) == {"url": URL, "title": "T", "description": "d", "site_name": "x.com"}


def test_snapshot_prefers_page_preview_titles(spark):
    body = {"success": True, "finalUrl": "https://f.org/", "body": " <p>kept as is</p>\n",
            "header": {"title": "plain", "ogTitle": " Og \n title", "twitterImage": "/t", "extra": 1}}
    row = _run(spark, P.webpagesnap_candidates, body, 200)
    assert row["content"] == "<p>kept as is</p>"
    assert _meta(row) == {"url": "https://f.org/", "title": "Og title", "image": "/t", "site_name": "x.com"}


def test_front_matter_is_read_before_the_cut(spark):
    text = "---\ntitle: A long enough title\ndescription: d\nauthor: no\n---\nbody text"
    row = _run(spark, P.markdownnew_candidates, text, max_bytes=4)
    assert row["content"] == "body"
    assert _meta(row) == {"url": URL, "title": "A long enough title", "description": "d", "site_name": "x.com"}


def test_readers_do_not_cut(spark):
    long = "a\n\n\n\nb" + "x" * 40_000
    assert len(_run(spark, P.defuddle_candidates, long)["content"]) == 40_004
    row = _run(spark, P.jina_candidates, f"  {long} \n")
    assert row["content"].startswith("a\n\nb") and len(row["content"]) == 40_004
    assert _meta(row) == {"url": URL}


def test_tweet(spark):
    body = {"code": 200, "tweet": {
        "url": URL, "text": "hi", "author": {"name": "N", "screen_name": "n", "avatar_url": "/a"},
        "media": {"photos": [{"url": "/p1"}, {"url": "/p2", "width": 3}], "videos": [{"url": "/v"}]},
        "likes": 1, "replies": 2}}
    row = _run(spark, P.tweet_candidates, body)
    assert row["content"] == (
        f"## N (@n)\n\nhi\n\n![](/p1)\n![](/p2)\n[视频](/v)\n\n👍 1  🔄 0  💬 2\n\n[查看原推文]({URL})\n")
    assert _meta(row) == {"url": URL, "title": "N (@n)", "description": "hi", "image": "/p1", "author": "N",
                          "site_name": "X (Twitter)"}
    assert row["content_type"] == "application/json"


def test_search_takes_the_first_result(spark):
    body = {"web": {"results": [{"title": "T", "url": "/u", "meta_url": None}, {"title": "no"}]}}
    row = _run(spark, P.search_candidates, body)
    assert row["content"] == "T\n\n" and _meta(row) == {"url": "/u", "title": "T"}
