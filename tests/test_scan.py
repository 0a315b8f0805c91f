"""Running values and trailing counts inside sorted chunks, against plain loops."""

import bisect
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.operators import scan, trailing
from gleanery.operators import schedule as R
from gleanery.operators.scan import Running


def _batches(rows, names, types, draw):
    """The rows in batches of any size, empty ones among them."""
    table, at = [], 0
    while at < len(rows) or not table:
        size = draw.choice([0, 1, 2, 7, 40])
        part = rows[at:at + size]
        table.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part) if part else [[]] * len(names), types)], names))
        at += size
    return table


@pytest.mark.parametrize("seed", range(12))
def test_running_values_go_on_from_batch_to_batch(seed):
    draw = random.Random(seed)
    keys = [(draw.choice([None, 0.5, float("nan")]), draw.choice([None, "a", "b"])) for _ in range(draw.choice([1, 4]))]
    rows = [({"x": x, "y": y}, draw.choice([None, draw.randint(-9, 9)]), draw.randint(-99, 99))
            for x, y in keys for _ in range(draw.randint(1, 60))]
    types = [pa.struct([("x", pa.float64()), ("y", pa.string())]), pa.int64(), pa.int64()]
    columns = [Running("total", "sum", "v"), Running("lead", "max", "w", less="total")]
    got = pa.Table.from_batches(scan._scan(_batches(rows, ["k", "v", "w"], types, draw), ["k"], columns)).to_pylist()
    assert len(got) == len(rows)
    last = total = lead = None
    for (k, v, w), r in zip(rows, got):
        if last is None or repr(k) != last:
            total = lead = None
        last = repr(k)
        total = total if v is None else (total or 0) + v
        lead = lead if total is None else w - total if lead is None else max(lead, w - total)
        assert (r["total"], r["lead"]) == (total, lead)


@pytest.mark.parametrize("seed", range(12))
def test_counts_inside_a_chunk(seed):
    draw = random.Random(seed)
    spread, window = draw.choice([3, 50, 1000]), draw.choice([1, 5, 400, 10_000])
    rows = sorted((draw.choice("ab"), draw.randint(0, spread)) for _ in range(draw.choice([1, 30, 200])))
    made = _batches(rows, [trailing.OWNER, trailing.TIME], [pa.string(), pa.int64()], draw)
    got = pa.Table.from_batches(trailing._count(iter(made), window)).to_pylist()
    assert [(r[trailing.OWNER], r[trailing.TIME]) for r in got] == rows
    for r in got:
        times = [t for k, t in rows if k == r[trailing.OWNER]]
        assert r["_upper"] == bisect.bisect_right(times, r[trailing.TIME])
        assert r["_low"] == bisect.bisect_right(times, r[trailing.TIME] - window)


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, us long").repartition(5)


@pytest.mark.parametrize("window", [1, 37, 5_000, 1_000_000])
@pytest.mark.parametrize("kind", ["one time", "few times", "gaps"])
def test_trailing_rate_over_many_chunks(spark, window, kind):
    """Times that fill several chunks, windows shorter and longer than a chunk, window starts between two chunks."""
    draw = random.Random(window)
    time = {"one time": lambda: 5_000 if draw.random() < 0.8 else draw.randint(0, 10_000),
            "few times": lambda: draw.choice([0, 37, 74, 5_000, 5_001]),
            "gaps": lambda: draw.randint(0, 40) * 1_000 + draw.randint(0, 3)}[kind]
    rows = [(i, draw.choice(["hot", "hot", None, f"k{i % 9}"]), time()) for i in range(900)] + [(900, "hot", None)]
    times = {}
    for _, k, us in rows:
        if us is not None:
            times.setdefault(k, []).append(us)
    times = {k: np.sort(t) for k, t in times.items()}
    want = {i: None if us is None else int(np.searchsorted(times[k], us, "right") - np.searchsorted(times[k], us - window, "right"))
            for i, k, us in rows}
    got = R.trailing_rate(_frame(spark, rows), "us", ["k"], window, chunks=11).collect()
    assert len(got) == len(rows) and {r["id"]: r["calls"] for r in got} == want


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a", 5)] * 40 + [(2, "a", 6)] * 3
    got = R.trailing_rate(_frame(spark, rows), "us", ["k"], 1, chunks=4).collect()
    assert sorted((r["id"], r["calls"]) for r in got) == [(1, 40)] * 40 + [(2, 3)] * 3
    assert R.trailing_rate(_frame(spark, rows).where("false"), "us", ["k"], 1, chunks=4).collect() == []
    empty = _frame(spark, rows).where("false").withColumn("delay", F.lit(1))
    assert R.politeness_schedule(empty, "k", "us", "id", "delay", chunks=4).collect() == []


@pytest.mark.parametrize("module, run", [
    (scan, lambda rows: R.politeness_schedule(rows.withColumn("delay", F.lit(3)), "k", "us", "id", "delay", chunks=4)),
    (trailing, lambda rows: R.trailing_rate(rows, "us", ["k"], 100, chunks=4)),
    (scan, lambda rows: scan.with_row_number(rows, ["us", "id"], "n", 4)),
])
def test_rows_are_shuffled_once(spark, monkeypatch, module, run):
    plans = []
    store = module.stored_table

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(module, "stored_table", seen)
    run(spark.range(500).selectExpr("id", "concat('h', id % 3) AS k", "id * 7 % 100 AS us"))
    assert plans[0].count("Exchange") == 1 and "Exchange rangepartitioning" in plans[0] and "Window" not in plans[0]
