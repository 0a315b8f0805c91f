import pytest
from pyspark.sql import functions as F

from gleanery import constants as C
from gleanery.catalog import staged as planted
from gleanery.functions.html import metadata_struct
from gleanery.functions.urls import url_hash
from gleanery.operators import joins
from gleanery.operators.providers import union_candidates
from gleanery.plans import staged as P
from gleanery.plans.fetch import fetch_results

DATA = "/root/testdata/sf0.001"
LONG = "long enough " * 12


def test_no_method_runs_before_one_that_a_route_tries_earlier():
    order = P.stage_order()
    assert set(order) == set(C.ALL_MODES)
    for plan in C.ROUTE_PLANS.values():
        assert sorted(plan, key=order.index) == list(plan)
    assert P.stage_order(["jina", "http"]) == ["http", "jina"]


def test_plans_that_disagree(monkeypatch):
    monkeypatch.setitem(C.ROUTE_PLANS, "stealth", ("jina", "defuddle"))
    with pytest.raises(ValueError):
        P.stage_order()


def _flat(results):
    return sorted(map(repr, results.select("request_url", "url", "mode", "content", "error", "selector_matched", "title").collect()))


@pytest.mark.parametrize("force_stealth,available", [(False, None), (True, None), (False, ("http", "jina", "fxtwitter", "defuddle"))])
def test_equals_parsing_everything(spark, force_stealth, available):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    frontier = documents.select(F.expr(planted._URL).alias("url"))
    answers = planted.answer_tables(documents)
    got = P.fetch_staged(frontier, answers, available=available, force_stealth=force_stealth)
    assert got.store is None
    modes = C.ALL_MODES if available is None else available
    everything = []
    for mode, saved in answers.items():
        if mode not in modes:
            continue
        address = F.expr(planted._URL)
        pages = documents.select(address.alias("url"), P.request_address(mode, address).alias("request_url"))
        joined = pages.join(saved, "request_url", "left" if mode == "fxtwitter" else "inner")
        joined = joined.where((F.col("request_url") == "") | (F.col("status").isNotNull())) if mode == "fxtwitter" else joined
        everything.append(P.CANDIDATES_OF[mode](joined.drop("request_url")))
    assert _flat(got.results) == _flat(fetch_results(
        frontier, union_candidates(*everything), available=modes, force_stealth=force_stealth))


def test_later_methods_see_less_and_join_before_they_parse(spark, tmp_path, monkeypatch):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = planted.fetched(spark, DATA).stages
    assert [s.mode for s in stages] == P.stage_order()
    shared = [s.wanted for s in stages if s.mode not in ("http", "fxtwitter")]
    assert shared == sorted(shared, reverse=True) and shared[-1] < shared[0] < documents.count()
    for stage in stages:
        assert stage.answers.count() <= stage.wanted
        lines = stage.answers.groupBy().count()._jdf.queryExecution().optimizedPlan().toString().splitlines()
        joined = next(i for i, line in enumerate(lines) if "Join Inner" in line)
        assert joined < next(i for i, line in enumerate(lines) if "parquet" in line)
        plan = P.CANDIDATES_OF[stage.mode](stage.answers)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        parse = next((i for i, line in enumerate(plan) if "ArrowEvalPython" in line or "from_json" in line), None)
        if parse is not None:  # what is below runs first
            assert parse < next(i for i, line in enumerate(plan) if "Join Inner" in line)


def _answers(spark, *rows):
    return spark.createDataFrame(list(rows), "request_url string, body string, status int")


def test_addresses_that_several_pages_share(spark):
    frontier = spark.createDataFrame([("https://x.com/u/status/1?s=1",), ("https://x.com/u/status/1?s=2",), ("https://x.com/u/status/1?s=2",)], "url string")
    post = '{"code": 200, "tweet": {"url": "t", "text": "hello", "author": {"name": "n", "screen_name": "s"}}}'
    saved = {"fxtwitter": _answers(spark, ("https://api.fxtwitter.com/u/status/1", post, 200))}
    rows = P.fetch_staged(frontier, saved).results.collect()
    assert sorted(r.request_url[-1] for r in rows) == ["1", "2"] and {r.mode for r in rows} == {"fxtwitter"}


def test_store_and_odd_frontiers(spark):
    known = "https://d.example/known"
    store = spark.createDataFrame([(known, "stored")], "url string, content string").select(
        url_hash("url").alias("url_hash"), "url", "content", metadata_struct().alias("metadata"),
        F.lit("2024-01-30").cast("timestamp").alias("created_at"))
    as_of = F.lit("2024-01-31").cast("timestamp")
    saved = {"jina": _answers(spark, ("https://r.jina.ai/https://d.example/new", LONG, 200), ("https://r.jina.ai/" + known, LONG, 200),
                              (None, LONG, 200), ("https://r.jina.ai/nobody", None, None))}
    frontier = spark.createDataFrame([(known,), ("https://d.example/new",), (None,), ("",), ("ftp://x",)], "url string")
    got = P.fetch_staged(frontier, saved, store, as_of)
    assert {r.request_url: r.mode for r in got.results.collect()} == {
        known: "cached", "https://d.example/new": "jina", None: "invalid", "": "invalid", "ftp://x": "invalid"}
    assert {r.url: r.content for r in got.store.collect()} == {known: "stored", "https://d.example/new": LONG.strip()}
    assert [(s.mode, s.wanted) for s in got.stages] == [("jina", 1)]
    assert P.fetch_staged(frontier.limit(0), saved, store, as_of).results.collect() == []
    assert {r.mode for r in P.fetch_staged(frontier.where("url like 'h%'"), {}).results.collect()} == {"failed"}


def test_only_folders_of_wanted_addresses_are_listed(spark, tmp_path, monkeypatch):
    rows = [(f"https://r.jina.ai/https://d.example/{i}", LONG, 200) for i in range(300)]
    P.write_answers(_answers(spark, *rows), str(tmp_path / "jina"))
    saved = spark.read.schema("request_url string, body string, status int, hash_prefix string").parquet(str(tmp_path / "jina"))
    frontier = spark.createDataFrame([("https://d.example/7",), ("https://d.example/1000",)], "url string")
    got = P.fetch_staged(frontier, {"jina": saved})
    assert sorted(r.mode for r in got.results.collect()) == ["failed", "jina"]
    assert "PartitionFilters: [hash_prefix" in got.stages[0].answers._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)  # a frontier too large to broadcast
    assert sorted(r.mode for r in P.fetch_staged(frontier, {"jina": saved}).results.collect()) == ["failed", "jina"]
