"""Several micro-batches must add up to the batch answer."""

import os
import time

import pytest
from pyspark.sql import functions as F

from gleanery.operators import metering as M
from gleanery.operators import schedule as R
from gleanery.operators.extract import extract_content
from gleanery.streaming.calls import stream_daily_calls, stream_rate
from gleanery.streaming.files import append_sink, file_stream, run_to_table, run_to_totals
from gleanery.streaming.limits import admit_sink, schedule_sink, stream_admit, stream_schedule
from gleanery.streaming.pages import dedup_stream, stream_extract

DATA = "/root/testdata/sf0.001"


def _files(frame, folder, order, pieces):
    """The rows in ``order``, cut into files that arrive one after the other."""
    rows = frame.toPandas().sort_values(order)
    os.makedirs(folder)
    size = -(-len(rows) // pieces)
    for i in range(pieces):
        path = f"{folder}/part-{i}.parquet"
        rows.iloc[i * size:(i + 1) * size].to_parquet(path, index=False, coerce_timestamps="us")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return file_stream(frame.sparkSession, folder, frame.schema)


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.fixture(scope="module")
def stream(events, tmp_path_factory):
    return _files(events, str(tmp_path_factory.mktemp("stream") / "events"), "ts", 4)


def _same(a, b):
    columns = a.columns
    assert a.count() == b.count()
    assert a.exceptAll(b.select(columns)).isEmpty()


def test_daily_calls(stream, events):
    _same(run_to_totals(stream_daily_calls(stream), "daily", ["date"], "count"), M.daily_calls(events))


def test_late_calls_are_counted(events, tmp_path):
    late = _files(events, str(tmp_path / "late"), ["user_id", "ts"], 5)
    _same(run_to_totals(stream_daily_calls(late), "daily", ["date"], "count"), M.daily_calls(events))


def test_rate(stream, events):
    got = run_to_totals(stream_rate(stream, width="1 hour"), "rate", ["second"], "calls")
    _same(got, events.groupBy(F.date_trunc("hour", "ts").alias("second")).agg(F.count("*").alias("calls")))


def test_admission(stream, events):
    def calls(rows):
        return rows.select("event_id", "user_id", R.micros("ts").alias("us"))

    day = 86_400_000_000
    got = run_to_table(stream_admit(calls(stream), "user_id", "us", "event_id", 2, day), "admit")
    expected = R.admit_calls(calls(events), "us", "event_id", 2, day, "user_id", chunks=5)
    assert 0 < expected.where("admitted").count() < events.count()
    _same(got, expected)


def test_admission_spread_over_tasks(stream, events, tmp_path):
    def calls(rows):
        return rows.select("event_id", F.lit(1).alias("all"), R.micros("ts").alias("us"), "value")

    hour = 3_600_000_000
    admit_sink(calls(stream), str(tmp_path), str(tmp_path / "cp"), "all", "us", "event_id", 1, hour).awaitTermination()
    got = events.sparkSession.read.parquet(str(tmp_path / "rows")).drop("_epoch")
    _same(got, R.admit_calls(calls(events), "us", "event_id", 1, hour, "all", chunks=5))
    assert len(list((tmp_path / "rows").glob("_epoch=*"))) == 4


def test_schedule_spread_over_tasks(stream, events, tmp_path):
    schedule_sink(
        _requests(stream), str(tmp_path), str(tmp_path / "cp"), "user_id", "us", "event_id", "delay").awaitTermination()
    got = events.sparkSession.read.parquet(str(tmp_path / "rows")).drop("_epoch")
    _same(got, R.politeness_schedule(_requests(events), "user_id", "us", "event_id", "delay", chunks=5))


def _requests(rows):
    return rows.select("event_id", "user_id", R.micros("ts").alias("us"),
                       (F.col("event_id") * 79_190_000 % 90_000_000_000).alias("delay"))


def test_schedule(stream, events):
    got = run_to_table(stream_schedule(_requests(stream), "user_id", "us", "event_id", "delay"), "schedule")
    expected = R.politeness_schedule(_requests(events), "user_id", "us", "event_id", "delay", chunks=5)
    assert expected.where("start_us > us").count() > 0
    _same(got, expected)


def test_schedule_with_forgetting(stream, events, tmp_path):
    """State with a time to live needs a clock, so this one is started and stopped."""
    scheduled = stream_schedule(_requests(stream), "user_id", "us", "event_id", "delay", ttl_ms=3_600_000)
    path = str(tmp_path / "rows")
    running = append_sink(scheduled, path, str(tmp_path / "checkpoint"), {"processingTime": "1 second"})
    try:
        until = time.time() + 60
        while time.time() < until:
            done = [p["numInputRows"] for p in running.recentProgress]
            if sum(done) >= events.count():
                break
            time.sleep(0.5)
    finally:
        running.stop()
    got = events.sparkSession.read.parquet(path)
    expected = R.politeness_schedule(_requests(events), "user_id", "us", "event_id", "delay", chunks=3)
    assert got.join(expected, ["event_id", "start_us"], "left_anti").isEmpty() and not got.isEmpty()


def test_extraction(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = run_to_table(stream_extract(_files(pages, str(tmp_path / "pages"), "page_id", 3)), "extract")
    _same(got.select("page_id", "content", "selector"), extract_content(pages).select("page_id", "content", "selector"))


def test_copies_within_the_time_to_live_are_dropped(spark, tmp_path):
    rows = [(0, "a"), (1, "b"), (2, "a"), (20, "c"), (21, "d"), (22, "a"), (23, "d")]
    arrivals = spark.createDataFrame(rows, "day int, url string").select(
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(days="day")).alias("ts"), "url")
    got = run_to_table(dedup_stream(_files(arrivals, str(tmp_path / "arrivals"), "ts", 7)), "dedup")
    kept = sorted((r["url"], r["ts"].timetuple().tm_yday - 1) for r in got.collect())
    assert kept == [("a", 0), ("a", 22), ("b", 1), ("c", 20), ("d", 21)]
