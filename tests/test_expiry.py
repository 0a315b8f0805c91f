import random

from pyspark.sql import functions as F

from gleanery.functions.html import metadata_struct
from gleanery.operators import schedule as R
from gleanery.operators import store as S
from gleanery.operators import versions as V
from gleanery.operators.select import FEW, newest_first, nth_row, text_bytes
from gleanery.streaming.expiry import expiry_sink, expiry_stream
from gleanery.streaming.files import file_stream, run_to_table
from gleanery.streaming.limits import stream_schedule

BASE = 1_704_067_200_000_000
DAY = 86_400_000_000


def _writes(spark, rows):
    return spark.createDataFrame(rows, "url string, day double").select(
        "url", F.timestamp_micros((F.lit(BASE) + F.col("day") * DAY).cast("long")).alias("created_at"))


def _as_stream(spark, batches, path):
    """One file for each batch, taken in that order."""
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(path)
    return file_stream(spark, path, batches[0].schema)


def _days(expired):
    return sorted((r["url"], round((r["us"] - BASE) / DAY, 6)) for r in expired.select("url", F.unix_micros("created_at").alias("us")).collect())


def test_entries_expire_with_event_time(spark, tmp_path):
    batches = [
        [("a", 0.0), ("b", 1.0), ("a", 3.0), ("a", 3.0), (None, 1.0), ("c", None)],
        [("b", 2.0), ("c", 9.0)],  # a's entry of day 3 lives to day 10, b's to day 9
        [("d", 11.5), ("a", 10.25)],  # a was written again after its entry had died
        [("e", 30.0)],
    ]
    got = run_to_table(expiry_stream(_as_stream(spark, [_writes(spark, b) for b in batches], str(tmp_path / "w"))), "expiry")
    assert _days(got) == [("a", 3.0), ("a", 10.25), ("b", 2.0), ("c", 9.0), ("d", 11.5)]


def test_expiry_is_the_same_in_one_batch_and_in_many(spark, tmp_path):
    draw = random.Random(5)
    rows = sorted(((f"u{draw.randrange(6)}", draw.randrange(0, 6000) / 100) for _ in range(120)), key=lambda r: r[1])
    expected = []
    for url in {r[0] for r in rows}:
        times = sorted({t for u, t in rows if u == url})
        for t, following in zip(times, [*times[1:], rows[-1][1] - 1]):
            if following > t + 7:
                expected.append((url, t))
    for k, cuts in enumerate(([0, 120], [0, 20, 50, 51, 90, 120])):
        batches = [_writes(spark, rows[a:b]) for a, b in zip(cuts, cuts[1:])]
        got = run_to_table(expiry_stream(_as_stream(spark, batches, str(tmp_path / str(k)))), "expiry")
        assert _days(got) == sorted(expected)


def test_expired_entries_leave_the_store(spark, tmp_path):
    rows = [("a", 0.0), ("b", 1.0), ("c", 12.0)]
    entries = _writes(spark, rows).select("*", F.lit("x").alias("content"), metadata_struct().alias("metadata"))
    root = str(tmp_path / "store")
    V.write_whole(S.latest_writes(entries), root)
    # b has been written again since the stream saw it.
    again = _writes(spark, [("b", 11.0)]).select("*", F.lit("y").alias("content"), metadata_struct().alias("metadata"))
    V.upsert_version(spark, root, again)
    stream = _as_stream(spark, [_writes(spark, rows)], str(tmp_path / "w"))
    expiry_sink(expiry_stream(stream), root, str(tmp_path / "cp")).awaitTermination()
    assert {r["url"]: r["content"] for r in V.read_version(spark, root).collect()} == {"b": "y", "c": "x"}
    before = V.versions(spark, root)
    gone = _writes(spark, rows[:2])
    V.delete_expired_version(spark, root, gone)  # a repeated micro-batch
    assert V.read_version(spark, root).count() == 2 and len(V.versions(spark, root)) == len(before) + 1


def test_hosts_are_forgotten_and_the_schedule_stays(spark, tmp_path):
    draw = random.Random(9)
    rows, us = [], BASE
    for i in range(300):
        us += draw.choice([0, 10, 1000, 5_000_000])
        rows.append((i, f"h{draw.randrange(8)}" if i < 200 else "late", us, draw.randrange(1, 3_000_000)))
    frame = spark.createDataFrame(rows, "id long, host string, us long, delay long")
    stream = _as_stream(spark, [frame.where(f"id >= {a} AND id < {a + 60}") for a in range(0, 300, 60)], str(tmp_path / "r"))
    scheduled = stream_schedule(stream, "host", "us", "id", "delay", most_delay_us=3_000_000)
    path, checkpoint = str(tmp_path / "rows"), str(tmp_path / "cp")
    query = scheduled.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    expected = R.politeness_schedule(frame, "host", "us", "id", "delay", chunks=3)
    got = spark.read.parquet(path)
    assert sorted(got.collect()) == sorted(expected.select(*got.columns).collect())
    kept = spark.read.format("statestore").option("stateVarName", "last_start").load(checkpoint)
    assert {r["key"][0] for r in kept.collect()} == {"late"}


def _table(spark, draw, size):
    times = [None, *(f"2024-01-{d:02d} 00:00:00" for d in (1, 2, 3)), "1950-05-05 00:00:00"]
    urls = ["", None, "https://site.example/é", *(f"https://site.example/{'x' * draw.randrange(3)}{draw.randrange(size)}" for _ in range(size))]
    rows = [(draw.choice(times), draw.choice(["00ff", "00fe", "", None, "zz"]), draw.choice(urls)) for _ in range(size)]
    return spark.createDataFrame(rows, "t string, h string, u string").select(F.col("t").cast("timestamp").alias("t"), "h", "u")


def test_nth_row_by_histograms(spark, monkeypatch):
    monkeypatch.setattr("gleanery.operators.select.FEW", 2)
    rows = _table(spark, random.Random(3), 400).persist()
    order = [newest_first(F.col("t")), text_bytes(F.col("h")), text_bytes(F.col("u"))]

    def rank(row):
        return (row["t"] is None, -row["t"].timestamp() if row["t"] else 0, (row["h"] or "").encode(), (row["u"] or "").encode())

    expected = sorted(map(rank, rows.collect()))
    for n in (7, 400):
        assert rank(nth_row(rows, order, n)) == expected[n - 1]
    assert nth_row(rows, order, 401) is None and nth_row(rows, order, 0) is None
    assert nth_row(rows.limit(0), order, 1) is None and FEW > 2


def test_capacity_of_a_store_written_at_one_time(spark, monkeypatch):
    monkeypatch.setattr("gleanery.operators.select.FEW", 4)
    rows = [(f"{i % 7:04x}", f"https://same.example/page/{i:05d}") for i in range(500)]
    store = spark.createDataFrame(rows, "url_hash string, url string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    for n in (72, 499):
        kept = {tuple(r)[:2] for r in S.evict_to_capacity(store, n).collect()}
        assert kept == set(sorted(rows)[:n])
    assert S.evict_to_capacity(store, 0).isEmpty() and S.evict_to_capacity(store, 501).count() == 500
