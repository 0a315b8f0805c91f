import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import joint
from gleanery.operators.joint import joint_schedule

ROWS = "id long, host string, us long, delay long"


def serial(rows, per_second, step):
    """One request after the other."""
    starts, last, order = [], {}, sorted((r for r in rows if None not in r[2:]), key=lambda r: (r[2], r[0]))
    for place, (_, host, us, delay) in enumerate(order):
        at = us
        if host in last:
            at = max(at, last[host] + delay)
        if place >= per_second:
            at = max(at, starts[place - per_second] + step)
        starts.append(at)
        last[host] = at
    made = {r[0]: at for r, at in zip(order, starts)}
    return {r[0]: made.get(r[0]) for r in rows}


def _frontier(draw, n, hosts, gap, delay):
    us, rows = 0, []
    for i in range(n):
        us += draw.choice([0, draw.randint(0, gap), draw.randint(0, gap), 40 * gap if draw.random() < 0.02 else 0])
        host = "hot" if draw.random() < 0.35 else draw.choice([None, *(f"h{k}" for k in range(hosts))])
        rows.append((i * 7919 % n, host, us, draw.randint(0, delay)))
    return rows


@pytest.mark.parametrize("n,hosts,gap,delay,per_second,step,chunks", [
    (300, 5, 10, 30, 3, 25, 7),        # both bind
    (300, 40, 3, 5, 2, 40, 9),         # all requests wait for one another
    (300, 2, 3, 60, 5, 10, 9),         # hosts are the bottleneck
    (200, 5, 500, 10, 4, 20, 6),       # little to wait for
    (60, 3, 5, 30, 25, 90, 20),        # spans shorter than the distance of two requests
    (1, 1, 1, 1, 5, 10, 4),
])
def test_equals_the_serial_walk(spark, n, hosts, gap, delay, per_second, step, chunks):
    rows = _frontier(random.Random(n + hosts + gap), n, hosts, gap, delay)
    table = spark.createDataFrame(rows, ROWS)
    got = joint_schedule(table, "host", "us", "id", "delay", per_second, step, chunks=chunks, span_rows=-(-n // chunks))
    assert {r.id: r.start_us for r in got.rows.collect()} == serial(rows, per_second, step)
    assert got.rounds <= chunks + 1


def test_rounds_do_not_follow_the_number_of_spans(spark):
    rows = _frontier(random.Random(2), 1500, 30, 40, 60)
    got = joint_schedule(spark.createDataFrame(rows, ROWS), "host", "us", "id", "delay", 4, 60, chunks=24, span_rows=63)
    assert {r.id: r.start_us for r in got.rows.collect()} == serial(rows, 4, 60)
    assert got.rounds <= 12


@pytest.mark.parametrize("followed,most", [(120, 1), (4, 24)])
def test_full_spans_are_right_after_one_round(spark, monkeypatch, followed, most):
    """Every request waits for others; with more hosts than a summary follows, rounds find the rest."""
    monkeypatch.setattr(joint, "FOLLOWED", followed)
    rows = _frontier(random.Random(5), 1500, 30, 3, 60)
    got = joint_schedule(spark.createDataFrame(rows, ROWS), "host", "us", "id", "delay", 4, 60, chunks=24, span_rows=63)
    assert {r.id: r.start_us for r in got.rows.collect()} == serial(rows, 4, 60)
    assert got.rounds <= most


def test_odd_rows(spark):
    rows = [(0, None, 5, 10), (1, None, 5, 10), (2, "", 5, 10), (3, "a", None, 10), (4, "a", 6, None), (5, "a", 7, 0)]
    table = spark.createDataFrame(rows, ROWS).withColumn("chunk", F.lit("x"))
    got = joint_schedule(table, "host", "us", "id", "delay", 2, 1).rows
    assert got.columns == ["id", "host", "us", "delay", "chunk", "start_us"]
    assert {r.id: r.start_us for r in got.collect()} == serial(rows, 2, 1)
    assert joint_schedule(table.limit(0), "host", "us", "id", "delay").rows.collect() == []
