import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleanery.operators import arrivals as A

START = datetime(2024, 1, 1)


def serial(rows, days):
    kept, last = [], {}
    for url, ts in sorted((r for r in rows if r[1] is not None), key=lambda r: r[1]):
        if url not in last or ts - last[url] > timedelta(days=days):
            last[url] = ts
            kept.append((url, ts))
    return sorted(kept, key=repr)


def _rows(draw, n, span_days):
    def at():
        # Whole hours, so that arrivals lie exactly one time to live apart.
        return START + timedelta(hours=draw.randint(0, span_days * 24), microseconds=draw.choice([0, 0, 0, 1]))

    return [("hot" if draw.random() < 0.4 else draw.choice([None, "", "a", "b", "c"]), at()) for _ in range(n)]


@pytest.mark.parametrize("n,span,days,chunks", [(400, 40, 7, 9), (500, 300, 2, 5), (300, 5, 7, 4), (50, 60, 0, 3), (200, 20, 1, 1)])
def test_equals_the_serial_walk(spark, n, span, days, chunks):
    rows = _rows(random.Random(n + span), n, span)
    rows += rows[:40] + [("a", None), (None, None)]
    table = spark.createDataFrame(rows, "url string, ts timestamp")
    got = A.dedup_arrivals(table, ttl_days=days, chunks=chunks).collect()
    assert sorted(((r.url, r.ts) for r in got), key=repr) == serial(rows, days)


def test_rounds_are_logarithmic(spark):
    rows = [("u", START + timedelta(days=8 * i)) for i in range(100)]
    times = spark.createDataFrame(rows, "url string, ts timestamp").select(
        F.struct("url").alias("_owner"), F.unix_micros("ts").alias("us"))
    kept, rounds = A.reached(A.next_arrivals(times, 7 * A.DAY, 4))
    assert kept.count() == 100 and rounds <= 8


def test_a_hot_url_is_spread_over_tasks(spark):
    times = spark.range(40_000).select(
        F.struct(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("url")).alias("_owner"),
        (F.col("id") * 1_000_003).alias("us"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = A.next_arrivals(times, 1000, 8)
        tasks = pieces.where("_owner.url = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) >= 3 and max(r["count"] for r in tasks) < 20_000


def test_empty_table(spark):
    assert A.dedup_arrivals(spark.createDataFrame([], "url string, ts timestamp")).collect() == []
