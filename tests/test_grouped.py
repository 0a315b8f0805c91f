import types

from pyspark.sql import Row
from pyspark.sql import functions as F

from gleanery.streaming.expiry import expiry_stream
from gleanery.streaming.files import append_sink, file_stream, run_to_table
from gleanery.streaming.limits import _Spacing, stream_schedule
from gleanery.streaming.pages import dedup_stream

URLS = 3000
DAY = 86_400
BASE = 1_704_067_200  # a watermark begins at 1970


def _run(spark, tmp_path, made, rows, late):
    """The rows of each file of ``rows`` through ``made``: what came out, and how many states were left."""
    path = str(tmp_path / "in")
    for batch in rows:
        frame = spark.createDataFrame(batch, "url string, second long")
        frame.select("url", F.timestamp_seconds(F.col("second") + BASE).alias("ts")).coalesce(1).write.mode("append").parquet(path)
    stream = file_stream(spark, path, spark.read.parquet(path).schema)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    append_sink(made(stream, "url", "ts", 7, late), out, checkpoint).awaitTermination()
    states = spark.read.format("statestore").option("stateVarName", "times").load(checkpoint).count()
    return spark.read.parquet(out), states


def test_urls_that_expire_share_the_state_of_their_group(spark, tmp_path):
    written = [(f"u{i}", i) for i in range(URLS)]
    gone, states = _run(spark, tmp_path, expiry_stream, [written, [("u0", DAY), ("last", 9 * DAY)]], "1 day")
    got = {(r["url"], r["us"]) for r in gone.select("url", (F.unix_seconds("created_at") - BASE).alias("us")).collect()}
    assert got == set(written[1:]) and 0 < states <= 2  # u0 was written again


def test_copies_share_the_state_of_their_group(spark, tmp_path):
    batches = [[(f"u{i}", i) for i in range(URLS)] + [(None, 5), (None, 6)], [(f"u{i}", DAY + i) for i in range(URLS)],
               [("u1", 8 * DAY), (None, 8 * DAY)]]
    kept, states = _run(spark, tmp_path, dedup_stream, batches, "30 days")
    got = sorted((r["url"] or "", r["s"]) for r in kept.select("url", (F.unix_seconds("ts") - BASE).alias("s")).collect())
    assert got == sorted([*batches[0][:-2], ("", 5), ("u1", 8 * DAY), ("", 8 * DAY)])
    assert 0 < states <= 32 * 4


class _Handle:
    """Counts the calls of the state."""

    def __init__(self):
        self.calls, self.value = [], None

    def getValueState(self, *_, **__):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timer = at


def test_a_host_is_read_once_and_written_once():
    clock = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: clock.now, now=0)
    handle, spacing = _Handle(), _Spacing((1, 0, 2), ["id", "us", "delay", "start_us"], None, 5_000)
    spacing.init(handle)
    request = Row("id", "us", "delay", "_at")
    first = list(spacing.handleInputRows(("h",), iter([request(2, 1_000, 500, 0), request(1, 1_000, 700, 0)]), clock))
    assert [tuple(r) for r in first] == [(1, 1_000, 700, 1_000), (2, 1_000, 500, 1_500)]
    assert handle.calls == ["get", "update", "timer"] and handle.timer == 7
    handle.calls.clear()
    rows = [request(3, 1_200, 400, 0), request(4, None, 1, 0), request(5, 1_300, None, 0)]
    second = list(spacing.handleInputRows(("h",), iter(rows), clock))
    assert [r[3] for r in second] == [1_900, None, None] and handle.calls == ["get", "update"]
    clock.now = 6
    list(spacing.handleExpiredTimer(("h",), clock, None))
    assert handle.value == (1_900,) and handle.timer == 7
    clock.now = 7
    list(spacing.handleExpiredTimer(("h",), clock, None))
    assert handle.value is None


def test_requests_without_a_host_wait_for_each_other(spark, tmp_path):
    rows = [(1, None, 10, 5), (2, 7, 10, 5), (3, None, 10, 5), (4, None, 11, 5), (5, 7, 11, 5)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "id long, host long, us long, delay long").coalesce(1).write.parquet(path)
    stream = file_stream(spark, path, spark.read.parquet(path).schema)
    got = run_to_table(stream_schedule(stream, "host", "us", "id", "delay"), "hosts").collect()
    assert sorted(map(tuple, got)) == [
        (1, None, 10, 5, 10), (2, 7, 10, 5, 10), (3, None, 10, 5, 15), (4, None, 11, 5, 20), (5, 7, 11, 5, 15)]
