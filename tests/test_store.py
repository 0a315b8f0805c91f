from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from gleanery.functions.html import metadata_struct
from gleanery.operators import store as S

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)


def _writes(spark, *rows):
    frame = spark.createDataFrame([(u, c, NOW - timedelta(seconds=age)) for u, c, age in rows],
                                  "url string, content string, created_at timestamp")
    return frame.withColumn("metadata", metadata_struct(title="content"))


def _contents(store):
    return {r["url"]: r["content"] for r in store.collect()}


def test_latest_write_wins_and_blank_ones_are_not_stored(spark):
    store = S.latest_writes(_writes(spark, ("a", "old", 9), ("a", "new", 1), ("b", "", 1), ("a", "", 0)))
    assert _contents(store) == {"a": "new"}


def test_upsert(spark):
    store = S.latest_writes(_writes(spark, ("a", "a0", 50), ("b", "b0", 5), ("c", "c0", 7)))
    writes = _writes(spark, ("a", "a1", 10), ("b", "b1", 9), ("c", "c1", 7), ("d", "d1", 1))
    merged = S.upsert_latest(store, writes)
    assert _contents(merged) == {"a": "a1", "b": "b0", "c": "c1", "d": "d1"}
    assert _contents(S.upsert_latest(merged, writes)) == _contents(merged)
    assert merged.count() == 4


def test_age_limit(spark):
    week = 7 * 86400
    store = S.latest_writes(_writes(spark, ("edge", "x", week), ("old", "x", week + 1), ("new", "x", 0)))
    assert set(_contents(S.valid_entries(store, NOW))) == {"edge", "new"}
    kept, removed = S.cleanup_expired(store, NOW)
    assert set(_contents(kept)) == {"edge", "new"} and removed.first()["removed"] == 1
    assert set(_contents(S.valid_entries(store, NOW, ttl_days=0))) == {"new"}


def test_lookup_needs_hash_and_url(spark):
    store = S.latest_writes(_writes(spark, ("a", "x", 0), ("old", "x", 99 * 86400)))
    frontier = spark.createDataFrame([("a",), ("a",), ("b",), ("old",)], "url string")
    assert sorted((r["url"], r["hit"]) for r in S.cache_lookup(frontier, store, NOW).collect()) == [
        ("a", True), ("a", True), ("b", False), ("old", False)]
    assert sorted(r["url"] for r in S.cache_misses(frontier, store, NOW).collect()) == ["b", "old"]
    assert S.cache_hits(frontier, store, NOW).count() == 2
    collision = store.withColumn("url", F.lit("other"))
    assert S.cache_hits(frontier, collision, NOW).count() == 0


def test_times(values):
    texts = ["2024-01-02T03:04:05.123456789Z", "2024-01-02T03:04:05.5+08:00", "2024-01-02 03:04:05",
             "2024-01-02T03:04:05Z", "2024-01-02", "", None]
    got = values(F.unix_micros(S.parse_created_at("x")), texts)
    base = int(datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc).timestamp()) * 1_000_000
    assert got == [base + 123456, base - 8 * 3600 * 1_000_000 + 500_000, base, base, None, None, None]


def test_metadata_json(values):
    got = values(S.meta_from_json("x"), ['{"title":"t","other":1}', "{bad", "", None, '{"title":5}'])
    assert got[0]["title"] == "t" and got[0]["url"] == ""
    assert got[1] is None and got[2] is None and got[3] is None


def test_capacity(spark):
    store = S.latest_writes(_writes(spark, *[(f"u{i}", "x", (i * 37) % 101) for i in range(101)]))
    kept = _contents(S.evict_to_capacity(store, 30))
    assert set(kept) == {f"u{i}" for i in range(101) if (i * 37) % 101 < 30}


def test_delete(spark):
    store = S.latest_writes(_writes(spark, ("a", "x", 0), ("b", "x", 0)))
    doomed = spark.createDataFrame([("a",), ("a",), ("c",)], "url string")
    assert set(_contents(S.delete_keys(store, doomed))) == {"b"}


def test_stored_files_can_be_pruned_by_prefix(spark, tmp_path):
    path = str(tmp_path / "store")
    store = S.latest_writes(_writes(spark, *[(f"u{i}", f"c{i}", i) for i in range(50)]))
    S.write_store(store, path)
    back = S.read_store(spark, path)
    assert _contents(back) == _contents(store)
    one = back.where(F.col("hash_prefix") == S.prefix_of(F.lit(store.where("url = 'u7'").first()["url_hash"])))
    assert "u7" in _contents(one)
    assert "PartitionFilters: [isnotnull(hash_prefix" in one._jdf.queryExecution().executedPlan().toString()
    few = spark.createDataFrame([("u7",), ("u9",), ("none",)], "url string")
    hits = S.cache_hits(few, back, NOW)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert {r["url"] for r in hits.collect()} == {"u7", "u9"} and "PartitionFilters: [hash_prefix" in plan
    assert [r["url"] for r in S.cache_misses(few, back, NOW).collect()] == ["none"]
    assert S.expire_store(spark, path, str(tmp_path / "fresh"), NOW + timedelta(days=7, seconds=-9.5)) == 40
    assert set(_contents(S.read_store(spark, str(tmp_path / "fresh")))) == {f"u{i}" for i in range(10)}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        S.write_store(store, path)


def test_capacity_keeps_by_comparison(spark):
    rows = [(f"{i:04d}", f"u{i}", f"c{i}", None, None if i % 10 == 0 else f"2024-01-{1 + i % 28:02d} 00:00:00") for i in range(300)]
    store = spark.createDataFrame(rows, "url_hash string, url string, content string, m string, t string").select(
        "url_hash", "url", "content", F.col("t").cast("timestamp").alias("created_at"))
    order = sorted(rows, key=lambda r: (r[4] is None, [-ord(c) for c in r[4] or ""], r[0], r[1]))
    for n in (0, 1, 100, 285, 300, 1000):
        kept = S.evict_to_capacity(store, n)
        assert {r["url"] for r in kept.collect()} == {r[1] for r in order[:n]}
    assert "Exchange" not in S.evict_to_capacity(store, 100)._jdf.queryExecution().executedPlan().toString()


def test_no_folder_is_made_up(spark):
    from gleanery.session import shared_dir

    class Unset:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("X", (), {"getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError):
        shared_dir(Unset)
