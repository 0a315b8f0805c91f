import bisect
import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import schedule as R
from gleanery.operators.scan import with_row_number

MIXES = {
    # third of the rows under one key, bursts of equal times, and long pauses
    "hot": lambda rng, i: (rng.choice(["hot", "hot", f"k{i % 40}"]), rng.randrange(0, 3_000_000)),
    "burst": lambda rng, i: (f"k{i % 3}", rng.choice([0, 0, 1_000_000, 5_000_000])),
    "sparse": lambda rng, i: (f"k{i % 5}", i * 700_000 + rng.randrange(1000)),
    "single": lambda rng, i: ("one", i * 1000),
}


def _rows(mix, n=1500):
    rng = random.Random(mix)
    rows = [(i, *MIXES[mix](rng, i), rng.randrange(0, 900_000)) for i in range(n)]
    return sorted(rows, key=lambda r: (r[2], r[0]))


def _frame(spark, rows):
    shuffled = random.Random(1).sample(rows, len(rows))
    return spark.createDataFrame(shuffled, "id long, k string, us long, delay long").repartition(5)


@pytest.mark.parametrize("mix", MIXES)
@pytest.mark.parametrize("chunks", [1, 13])
def test_politeness_schedule_equals_waiting_in_turn(spark, mix, chunks):
    rows, last, expected = _rows(mix), {}, {}
    for i, key, us, delay in rows:
        last[key] = expected[i] = us if key not in last else max(us, last[key] + delay)
    got = R.politeness_schedule(_frame(spark, rows), "k", "us", "id", "delay", chunks=chunks)
    assert {r["id"]: r["start_us"] for r in got.collect()} == expected


@pytest.mark.parametrize("mix", MIXES)
@pytest.mark.parametrize("k, chunks", [(1, 7), (4, 13)])
def test_global_schedule_equals_waiting_in_turn(spark, mix, k, chunks):
    rows, starts, expected = _rows(mix), [], {}
    for n, (i, _, us, _) in enumerate(rows):
        starts.append(us if n < k else max(us, starts[n - k] + 1_010_000))
        expected[i] = starts[-1]
    got = R.global_schedule(_frame(spark, rows), "us", "id", per_second=k, chunks=chunks)
    assert {r["id"]: r["global_us"] for r in got.collect()} == expected


@pytest.mark.parametrize("mix", MIXES)
@pytest.mark.parametrize("limit, window, per", [
    (3, 1_000_000, None), (2, 250_000, "k"),
])
def test_admission_equals_a_sliding_log(spark, mix, limit, window, per):
    rows, logs, expected = _rows(mix), {}, {}
    for i, key, us, _ in rows:
        log = logs.setdefault(key if per else "", [])
        log[:] = [t for t in log if t > us - window]
        expected[i] = len(log) < limit
        if expected[i]:
            log.append(us)
    got = R.admit_calls(_frame(spark, rows), "us", "id", limit, window, per, chunks=11).collect()
    assert {r["id"]: r["admitted"] for r in got} == expected
    assert all(r["code"] == (200 if r["admitted"] else 429) for r in got)
    admitted = sorted(r["us"] for r in got if r["admitted"])
    if not per:
        assert all(b - a >= window for a, b in zip(admitted, admitted[limit:]))


def test_admission_is_off_without_a_limit(spark):
    got = R.admit_calls(_frame(spark, _rows("burst", 50)), "us", "id", 0)
    assert got.where("admitted AND code = 200").count() == 50


def test_calls_without_a_key_share_a_log(spark):
    rows = spark.createDataFrame([(i, None, i) for i in range(20)] + [(100, "a", 3)], "id long, k string, us long")
    got = R.admit_calls(rows, "us", "id", 2, 1_000_000, "k", chunks=6)
    assert {r["id"] for r in got.where("admitted").collect()} == {0, 1, 100}


@pytest.mark.parametrize("mix", MIXES)
def test_trailing_rate(spark, mix):
    rows = _rows(mix)
    times = [r[2] for r in rows]
    got = R.trailing_rate(_frame(spark, rows), "us", window_us=1_000_000, chunks=9).collect()
    assert {r["id"]: r["calls"] for r in got} == {
        i: bisect.bisect_right(times, us) - bisect.bisect_right(times, us - 1_000_000) for i, _, us, _ in rows}
    assert len(got) == len(rows)


@pytest.mark.parametrize("mix", ["hot", "burst"])
def test_trailing_rate_per_key(spark, mix):
    rows, times = _rows(mix), {}
    for _, key, us, _ in rows:
        times.setdefault(key, []).append(us)
    got = R.trailing_rate(_frame(spark, rows), "us", ["k"], 700_000, chunks=9).collect()
    assert {r["id"]: r["calls"] for r in got} == {
        i: bisect.bisect_right(times[k], us) - bisect.bisect_right(times[k], us - 700_000) for i, k, us, _ in rows}


def test_row_number(spark):
    rows = _rows("hot")
    ranked = with_row_number(_frame(spark, rows), ["us", "id"], "n", 9)
    assert [r["id"] for r in sorted(ranked.collect(), key=lambda r: r["n"])] == [r[0] for r in rows]


def test_delays(spark):
    hosts = ["mp.weixin.qq.com", "zhuanlan.zhihu.com", "juejin.cn", "csdn.net", "sspai.com", "a.juejin.cn", ""]
    frame = spark.createDataFrame([(h, f"https://{h}/{i}") for i, h in enumerate(hosts)], "domain string, url string")
    rows = R.with_domain_delay(frame).withColumn("delay", R.jitter("url")).collect()
    assert [(r["min_delay"], r["max_delay"]) for r in rows] == [
        (2.0, 3.5), (1.5, 2.5), (1.0, 1.8), (0.5, 1.0), (0.3, 0.8), (0.5, 1.2), (0.5, 1.2)]
    assert all(r["min_delay"] <= r["delay"] < r["max_delay"] for r in rows)


def test_delays_are_spread_and_repeatable(spark):
    urls = spark.range(2000).select(F.concat(F.lit("https://a.b/"), F.col("id").cast("string")).alias("url"))
    first = [r[0] for r in urls.select(R.unit_hash("url")).collect()]
    assert first == [r[0] for r in urls.select(R.unit_hash("url")).collect()]
    assert 0 <= min(first) < 0.01 and 0.99 < max(first) < 1


def test_rows_without_a_key_or_time_are_kept(spark):
    rows = spark.createDataFrame([(1, None, 0, 5), (2, None, 1, 5), (3, "a", 0, 5), (4, "a", 9, 5)],
                                 "id long, k string, us long, delay long")
    got = {r["id"]: r["start_us"] for r in R.politeness_schedule(rows, "k", "us", "id", "delay", chunks=3).collect()}
    assert got == {1: 0, 2: 5, 3: 0, 4: 9}
    untimed = rows.withColumn("us", F.when(F.col("id") != 3, F.col("us")))
    got = {r["id"]: r["calls"] for r in R.trailing_rate(untimed, "us", ["k"], 1_000_000).collect()}
    assert got == {1: 1, 2: 2, 3: None, 4: 1}
