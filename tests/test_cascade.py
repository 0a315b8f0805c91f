import json
import random

import pytest
from pyspark.sql import functions as F

from gleanery import constants as C
from gleanery.functions.html import metadata_struct
from gleanery.operators import cascade as K
from gleanery.plans.fetch import batch_fetch, fetch_results
from gleanery.schemas import CANDIDATE
from gleanery.sources.envelope import rejection_json

HOSTS = {"normal": "https://n.org/", "stealth": "https://juejin.cn/", "twitter": "https://x.com/"}


def _expected(url, rows, available):
    """One URL at a time, method by method."""
    browser = "stealth" in available
    route = "twitter" if "x.com" in url else "stealth" if "juejin" in url and browser else "normal"
    by_mode = {r["mode"]: r for r in rows}
    for mode in C.ROUTE_PLANS[route]:
        row = by_mode.get(mode)
        if mode not in available or row is None or row["error"] is not None:
            continue
        size = len(row["content"].encode())
        kind = row["content_type"] if mode == "http" else "text/html"
        if mode == "brave-search" or (mode == "fxtwitter" and row["content"].strip()) or (
                mode != "fxtwitter" and (size >= 100 or (kind == "text/plain" and size >= 3))):
            return mode, row["content"], None

    def shown(mode):
        error = by_mode.get(mode, {}).get("error")
        return "<nil>" if error is None else error

    head = {"normal": f"http={shown('http')}", "stealth": f"browser={shown('stealth')}, firecrawl=skipped",
            "twitter": f"fxtwitter={shown('fxtwitter')}, browser="}[route]
    tail = "".join(f", {label}={shown(mode)}" for label, mode in (
        ("webpagesnap", "webpagesnap"), ("markdownnew", "markdown-new"), ("defuddle", "defuddle"), ("jina", "jina")))
    return "failed", "", f"all methods failed: {head}{tail}"


@pytest.mark.parametrize("available", [C.ALL_MODES, tuple(m for m in C.ALL_MODES if m not in C.OPTIONAL_MODES)])
def test_select_best_agrees_with_trying_methods_in_order(spark, available):
    rng = random.Random(7)
    rows = []
    for i in range(150):
        url = rng.choice(list(HOSTS.values())) + str(i)
        for mode in C.ALL_MODES:
            if rng.random() < 0.6:
                error = f"{mode} broke" if rng.random() < 0.5 else None
                content = "" if error else mode + "x" * rng.choice([0, 0, 120])
                rows.append({"url": url, "mode": mode, "content": content, "error": error, "selector": "s",
                             "content_type": rng.choice(["text/html", "text/plain"]), "metadata": None})
    frame = spark.createDataFrame(rows, CANDIDATE)
    frontier = spark.createDataFrame([(r["url"],) for r in rows] + [("https://n.org/none",)], "url string")
    got = {r["request_url"]: (r["mode"], r["content"], r["error"])
           for r in K.select_best(frame, frontier, available=available).collect()}
    urls = {r["url"] for r in rows} | {"https://n.org/none"}
    assert got == {u: _expected(u, [r for r in rows if r["url"] == u], available) for u in urls}


def test_copies_of_a_candidate_change_nothing(spark):
    base = spark.createDataFrame([("https://n.org/1", "http", "x" * 200, "text/html", "s", None, None)], CANDIDATE)
    many = base.crossJoin(spark.range(5000)).drop("id")
    assert K.select_best(many).count() == 1
    assert K.select_best(many).first()["content"] == "x" * 200


def test_forced_rendering(spark):
    plan = K.plan_routes(spark.createDataFrame([("https://n.org",)], "url string"), force_stealth=True).collect()
    assert [(r["priority"], r["mode"]) for r in plan] == list(enumerate(C.ROUTE_PLANS["stealth"], 1))
    assert {r["route"] for r in plan} == {"stealth"}


def test_attempts(spark):
    rows = spark.createDataFrame([
        ("ok", 1, None, "a"), ("ok", 2, "late", "b"), ("second", 1, "e1", "a"), ("second", 2, None, "b"),
        ("third", 1, "e1", "a"), ("third", 2, "e2", "b"), ("third", 3, None, "c"),
    ], "url string, attempt int, error string, html string")
    got = {r["url"]: tuple(r)[1:] for r in K.resolve_attempts(rows, ["url"], payload=["html"], max_attempts=2).collect()}
    assert got == {"ok": (True, 1, "a", None), "second": (True, 2, "b", None), "third": (False, None, None, "e2")}
    assert K.resolve_attempts(rows, ["url"], payload=["html"]).where("url = 'third'").first()["ok_attempt"] == 3


def test_equal_rows_are_told_apart_whatever_their_order(spark):
    schema = "url string, mode string, content string, content_type string, selector string, metadata struct<title: string>, error string"
    rows = [("https://n.org/1", "http", c * 200, "text/html", "article", (c,), None) for c in "abcdefg"]
    tries = [("t", 1, None, x, y) for x, y in zip("abcd", "wxyz")]
    for shift in range(3):
        candidates = spark.createDataFrame(rows[shift:] + rows[:shift], schema).repartition(3)
        best = K.weigh_candidates(candidates).first()["_best"]
        assert best["content"][0] == best["metadata"]["title"]
        attempts = spark.createDataFrame(tries[shift:] + tries[:shift], "k string, attempt int, error string, a string, b string")
        kept = K.resolve_attempts(attempts.repartition(3), ["k"], payload=["a", "b"]).first()
        assert (kept["a"], kept["b"]) in list(zip("abcd", "wxyz"))
        first = (best["content"], kept["a"]) if not shift else first
        assert (best["content"], kept["a"]) == first


@pytest.fixture(scope="module")
def results(spark):
    candidates = spark.createDataFrame([
        ("https://n.org/1", "http", "x" * 200, "text/html", "article", None, None),
        ("https://n.org/2", "http", "", "text/html", "", None, "HTTP 500"),
        ("https://n.org/3", "http", "y" * 200, "text/html", "article", None, None),
        ("ftp://n.org", "http", "y" * 200, "text/html", "article", None, None),
    ], CANDIDATE).withColumn("metadata", metadata_struct(url=F.concat("url", F.lit("#c")), title=F.lit("T")))
    store = spark.createDataFrame([("https://n.org/3", "2024-01-01 00:00:00")], "url string, t string").select(
        F.substring(F.sha2("url", 256), 1, 16).alias("url_hash"), "url", F.lit("kept").alias("content"),
        metadata_struct(title=F.lit("Kept")).alias("metadata"), F.to_timestamp("t").alias("created_at"))
    frontier = spark.createDataFrame(
        [("https://n.org/1",), ("https://n.org/1",), ("https://n.org/2",), ("https://n.org/3",), ("ftp://n.org",),
         ("",)], "url string")
    return frontier, candidates, store


def test_fetch_results(spark, results):
    frontier, candidates, store = results
    as_of = F.lit("2024-01-08 00:00:00").cast("timestamp")
    rows = {r["request_url"]: r for r in fetch_results(frontier, candidates, store, as_of).collect()}
    assert {u: r["mode"] for u, r in rows.items()} == {
        "https://n.org/1": "http", "https://n.org/2": "failed", "https://n.org/3": "cached", "ftp://n.org": "invalid",
        "": "invalid"}
    best, kept, failed = rows["https://n.org/1"], rows["https://n.org/3"], rows["https://n.org/2"]
    assert (best["url"], best["title"], best["selector_matched"], best["content_length"]) == (
        "https://n.org/1#c", "T", "article", 200)
    assert (kept["url"], kept["title"], kept["content"], kept["selector_matched"]) == (
        "https://n.org/3", "Kept", "kept", None)
    assert failed["metadata"]["url"] == "https://n.org/2" and failed["error"].startswith("all methods failed: http=HTTP 500")
    assert rows[""]["error"] == "URL 校验失败: URL 不能为空"
    fresh = {r["request_url"]: r["mode"] for r in fetch_results(frontier, candidates).collect()}
    assert fresh["https://n.org/3"] == "http"


def test_batches_keep_order_and_copies(spark, results):
    frontier, candidates, _ = results
    asked = ["https://n.org/2", "https://n.org/1", "ftp://n.org", "https://n.org/1"]
    requests = spark.createDataFrame([(1, asked), (2, ["https://n.org/1"] * 21), (3, [])], "batch_id int, urls array<string>")
    answers = {r["batch_id"]: json.loads(r["json"])
               for r in batch_fetch(requests, fetch_results(frontier, candidates), max_urls=20).collect()}
    whole = {r["batch_id"]: json.loads(r["json"]) for r in batch_fetch(requests, fetch_results(frontier, candidates)).collect()}
    assert len(whole[2]["data"]) == 21
    assert answers[2] == {"code": 400, "message": "最多支持 20 个 URL"}
    assert answers[3] == {"code": 200, "message": "success", "data": []}
    items = answers[1]["data"]
    assert [i["url"] for i in items] == ["https://n.org/2", "https://n.org/1#c", "ftp://n.org", "https://n.org/1#c"]
    assert set(items[0]) == {"url", "success", "error"}
    assert items[1]["selector_matched"] == "article" and "error" not in items[1]


def test_rejected_calls(spark):
    rows = spark.createDataFrame([(200,), (429,)], "code int").select(rejection_json().alias("json")).collect()
    assert rows[0]["json"] is None
    assert json.loads(rows[1]["json"]) == {"code": 429, "message": C.MSG_RATE_LIMITED}
