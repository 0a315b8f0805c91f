"""What the plans look like at scale: no cross joins, pushed filters, split hot keys, small shuffles."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gleanery.functions.html import metadata_struct
from gleanery.operators import cascade as K
from gleanery.operators import joins
from gleanery.operators import metering as M
from gleanery.operators import store as S
from gleanery.catalog.cascade import planted_candidates

DATA = "/root/testdata/sf0.001"


def _plan(frame, run=False):
    if run:
        frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["fetch_results", "batch_fetch", "cache_lookup", "cache_upsert", "route_plan",
                                  "politeness_schedule", "trailing_rate", "best_candidate", "cache_capacity"])
def test_no_cross_joins(spark, name):
    plan = _plan(entry.queries()[name](spark, DATA))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_counts_are_reduced_before_the_shuffle(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    plan = _plan(M.daily_calls(events))
    assert "partial_count" in plan and plan.count("Exchange") == 1 and "ReadSchema: struct<ts:timestamp_ntz>" in plan


def test_candidates_are_reduced_before_the_only_shuffle(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = _plan(K.select_best(planted_candidates(documents)))
    assert "partial_min_by" in plan and plan.count("Exchange hashpartitioning") == 1


def _final(frame):
    return _plan(frame, run=True).split("== Initial Plan ==")[0]


def _big_store(spark):
    return spark.range(20_000).select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.repeat(F.lit("x"), 200).alias("content"),
        metadata_struct().alias("metadata"), F.lit("2024-01-30").cast("timestamp").alias("created_at"),
    ).withColumn("url_hash", F.substring(F.sha2("url", 256), 1, 16))


@pytest.fixture
def without_broadcast(spark):
    """Sizes scaled down so that small data meets the limits large data would."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


@pytest.mark.parametrize("lookup", [S.cache_lookup, S.cache_misses])
def test_a_hot_url_is_split_over_tasks(spark, tmp_path, without_broadcast, lookup):
    path = str(tmp_path / "store")
    _big_store(spark).write.parquet(path)
    frontier = spark.range(0, 300_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit("u7")).otherwise(
            F.concat(F.lit("u"), (F.col("id") * 7919 % 40_000).cast("string"))).alias("url"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    frame = lookup(frontier, spark.read.parquet(path), F.lit("2024-01-31").cast("timestamp"), narrow=False)
    rows = frame.count() if lookup is S.cache_misses else frame.where("hit").count()
    plan = _plan(frame, run=True)
    assert "skew=true" in plan
    hits = 300_000 - rows if lookup is S.cache_misses else rows
    assert hits == frontier.where("CAST(substring(url, 2) AS INT) < 20000").count()


def test_lookups_of_misses_read_no_content(spark, tmp_path):
    path = str(tmp_path / "store")
    _big_store(spark).write.parquet(path)
    store = spark.read.parquet(path)
    frontier = spark.createDataFrame([("u1",), ("none",)], "url string")
    plan = _plan(S.cache_misses(frontier, store, F.lit("2024-01-31").cast("timestamp"), narrow=False))
    schema = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "content" not in schema and "metadata" not in schema


def test_few_writes_do_not_shuffle_the_store(spark, tmp_path):
    path = str(tmp_path / "store")
    _big_store(spark).write.parquet(path)
    writes = spark.createDataFrame([("u1", "new")], "url string, content string").select(
        "*", metadata_struct().alias("metadata"), F.lit("2024-01-31").cast("timestamp").alias("created_at"))
    store = spark.read.parquet(path)
    merged = S.upsert_latest(store, writes)
    store_side = _final(merged).split("BroadcastExchange")[0]
    assert "BroadcastHashJoin" in store_side and "ShuffleQueryStage" not in store_side
    assert merged.count() == 20_000
    found = _final(S.cache_lookup(writes.select("url"), store, F.lit("2024-01-31").cast("timestamp")))
    assert "BroadcastHashJoin" in found and "Exchange hashpartitioning(url_hash" not in found
    deleted = S.delete_keys(store, writes.select("url"))
    assert "Exchange hashpartitioning(url_hash" not in _final(deleted) and deleted.count() == 19_999


def test_many_keys_are_not_broadcast(spark, monkeypatch):
    keys = spark.range(1000).select(F.col("id").cast("string").alias("url"))
    assert "ResolvedHint (strategy=broadcast)" in joins.broadcast_if_small(keys)._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 100)
    assert joins.broadcast_if_small(keys) is keys


def test_saved_pages_are_read_by_key_and_method(spark):
    """Stored and invalid URLs are never parsed, and a later method sees only what earlier ones left."""
    from datetime import datetime

    from gleanery.functions.html import metadata_struct
    from gleanery.functions.urls import url_hash
    from gleanery.operators.providers import http_candidates, rendered_candidates
    from gleanery.plans.fetch import fetch_saved

    long = "<article>" + "word " * 40 + "</article>"
    pages = spark.createDataFrame([(f"https://n.org/{i}", long if i % 2 else "short") for i in range(20)], "url string, html string")
    rendered = spark.createDataFrame([(f"https://n.org/{i}", long) for i in range(30)], "url string, html string")
    store = spark.createDataFrame([("https://n.org/1",), ("https://n.org/2",)], "url string").select(
        url_hash("url").alias("url_hash"), "url", F.lit("kept").alias("content"), metadata_struct().alias("metadata"),
        F.lit(datetime(2024, 1, 30)).alias("created_at"))
    frontier = spark.createDataFrame([(f"https://n.org/{i}",) for i in range(12)] + [("ftp://x",)], "url string")
    seen = {}

    def watched(name, candidates_of):
        def run(near):
            seen[name] = {int(r["url"].rpartition("/")[2]) for r in near.select("url").collect()}
            assert "ArrowEvalPython" not in near._jdf.queryExecution().executedPlan().toString()
            return candidates_of(near)
        return run

    results, kept = fetch_saved(
        frontier, [(watched("http", http_candidates), pages), (watched("rendered", rendered_candidates), rendered)],
        store, F.lit(datetime(2024, 1, 31)))
    assert seen == {"http": {0, *range(3, 12)}, "rendered": {0, 4, 6, 8, 10}}
    modes = {r["request_url"]: r["mode"] for r in results.collect()}
    assert modes["ftp://x"] == "invalid" and modes["https://n.org/1"] == "cached"
    assert modes["https://n.org/3"] == "http" and modes["https://n.org/4"] == "stealth"
    assert {r["url"] for r in kept.collect()} == {f"https://n.org/{i}" for i in range(12)}
