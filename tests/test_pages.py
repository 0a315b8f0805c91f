import gzip

import pyarrow as pa
from pyspark.sql import functions as F

from gleanery.functions.html import fix_lazy_images
from gleanery.operators import extract
from gleanery.operators.extract import extract_content, extract_metadata, html_to_markdown_udf
from gleanery.operators.providers import http_candidates, rendered_candidates
from gleanery.sources.responses import decode_body, read_responses, responses_to_pages, status_error
from gleanery.schemas import RESPONSE

LONG = "long enough " * 20


def test_extract(spark):
    pages = spark.createDataFrame([
        (1, "https://h.com:80/a", f"<title> T \n t</title><article>{LONG}</article>"),
        (2, "https://mp.weixin.qq.com/s/1", f"<article>{LONG}</article><div id=js_content><p>{LONG}我</p></div>"),
        (3, "https://h.com/b", None),
        (4, None, "<link rel=canonical href='https://c.org/'>x"),
    ], "id int, url string, html string")
    rows = {r["id"]: r for r in extract_content(pages).collect()}
    assert rows[1]["selector"] == "article" and rows[1]["content"] == LONG.strip()
    assert rows[1]["metadata"].asDict() == {
        "url": "https://h.com:80/a", "title": "T t", "description": "", "image": "", "author": "", "publish_date": "",
        "site_name": "h.com"}
    assert rows[2]["selector"] == "div#js_content"
    assert rows[2]["content_length"] == len(rows[2]["content"].encode())
    assert rows[3]["content"] == "" and rows[3]["selector"] == "body(fallback)"
    assert rows[4]["metadata"]["url"] == "https://c.org/" and rows[4]["metadata"]["site_name"] == ""
    assert {r["metadata"]["title"] for r in extract_metadata(pages).where("id = 1").collect()} == {"T t"}
    assert "html" in extract_content(pages, keep_html=True).columns


def test_markdown_in_sql(spark):
    spark.udf.register("to_markdown", html_to_markdown_udf())
    assert spark.sql("SELECT to_markdown('<h2>a</h2>') AS m").first()["m"] == "## a"


def test_lazy_images(values):
    html = ['<img class="a" data-src="/x.png" alt="b">', "<img data-src='/x.png'>", '<img data-src="">']
    assert values(fix_lazy_images("x"), html) == ['<img class="a" src="/x.png" alt="b">', *html[1:]]


def _responses(spark):
    html = f"<article>{LONG}é中</article>"
    zipped = gzip.compress(html.encode())
    rows = [
        ("plain", 200, "text/html", "", html.encode()),
        ("gzip", 200, "text/html", "GZIP", zipped),
        ("members", 200, "text/html", "gzip", gzip.compress(html[:50].encode()) + gzip.compress(html[50:].encode())),
        ("magic", 200, "text/html", None, zipped),
        ("not-gzip", 200, "text/html", "gzip", html.encode()),
        ("cut-gzip", 200, "text/html", "gzip", zipped[:-20]),
        ("gbk", 200, "text/html", "", f"<article>{LONG}中文</article>".encode("gbk")),
        ("gzip-gbk", 200, "text/html", "gzip", gzip.compress(f"<article>{LONG}中文</article>".encode("gbk"))),
        ("br", 200, "text/html", "br", b"\x8b\x02"),
        ("missing", 404, "text/html", "", html.encode()),
        ("large", 200, "text/html", "", b"x" * 3000),
        ("bomb", 200, "text/html", "gzip", gzip.compress(b"x" * 3000)),
        ("empty", 200, None, None, None),
    ]
    return spark.createDataFrame([(*r, None) for r in rows], RESPONSE)


def test_decode(spark):
    decoded = {r["url"]: r for r in decode_body(_responses(spark), max_bytes=2500).collect()}
    html = f"<article>{LONG}é中</article>"
    for name in ("plain", "gzip", "members", "magic", "not-gzip"):
        assert (decoded[name]["text"], decoded[name]["decode_error"]) == (html, None), name
    for name in ("gbk", "gzip-gbk"):
        assert decoded[name]["text"] == f"<article>{LONG}中文</article>"
    for name in ("cut-gzip", "br", "large", "bomb"):
        assert decoded[name]["text"] is None and decoded[name]["decode_error"], name
    assert decoded["empty"]["text"] is None and decoded["empty"]["decode_error"] is None


def test_responses_to_candidates(spark, tmp_path):
    path = str(tmp_path / "responses")
    _responses(spark).write.parquet(path)
    pages = responses_to_pages(read_responses(spark, path))
    rows = {r["url"]: r for r in http_candidates(pages).collect()}
    assert len(rows) == 13
    assert rows["missing"]["error"] == "HTTP 404" and rows["missing"]["content"] == ""
    assert rows["gzip"]["error"] is None and rows["gzip"]["selector"] == "article"
    assert rows["cut-gzip"]["error"] == "读取响应失败"
    rendered = rendered_candidates(pages.where("url = 'plain'")).first()
    assert (rendered["mode"], rendered["content_type"]) == ("stealth", "text/html")


def test_status(spark):
    rows = spark.createDataFrame([(200,), (500,), (None,)], "status int")
    assert [r[0] for r in rows.select(status_error("status")).collect()] == [None, "HTTP 500", "HTTP 0"]


def test_a_filter_before_extraction_reaches_the_scan_and_parsing_happens_once(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").where(F.col("page_id") > 10)
    plan = extract_content(pages).where("selector = 'article'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "GreaterThan(page_id,10)" in plan


def test_large_bodies_are_kept(spark):
    body = b"<p>" + b"x" * (12 << 20)
    rows = spark.createDataFrame(
        [("plain", 200, "text/html", "", body, None), ("gzip", 200, "text/html", "gzip", gzip.compress(body), None)], RESPONSE)
    got = decode_body(rows).select(F.length("text"), "decode_error").collect()
    assert [tuple(r) for r in got] == [(len(body), None)] * 2


def test_long_content_is_not_cut(spark):
    page = "<article>" + "word " * 10_000 + "</article>"
    rows = spark.createDataFrame([("https://a.org", page)], "url string, html string")
    assert extract_content(rows).first()["content_length"] == 49_999
    assert extract_content(rows, max_bytes=30_000).first()["content_length"] == 30_000


def test_pages_of_a_batch_are_converted_in_pieces(monkeypatch):
    read, sizes, real = extract.parse_page_udf().func, [], pa.array
    pages = pa.array([f"<title>t{i}</title><article>{LONG}</article>" for i in range(10)])
    wechat = pa.array([False] * 10)
    whole = read(pages, wechat)
    monkeypatch.setattr(extract, "PAGES", 3)
    monkeypatch.setattr(pa, "array", lambda values, kind: (sizes.append(len(values)), real(values, kind))[1])
    assert read(pages, wechat).equals(whole) and max(sizes) == 3
    assert len(read(pages.slice(0, 0), wechat.slice(0, 0))) == 0
