import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import negatives

VECTORS = "vec_id long, label int, vector array<double>"


def brute_force(rows, is_anchor, positives=5, negatives_=3, window=(50, 95)):
    rows = [r for r in rows if None not in r and all(x is not None and np.isfinite(x) for x in r[2])]
    width = max((len(r[2]) for r in rows), default=0)
    vectors = np.array([list(r[2]) + [0] * (width - len(r[2])) for r in rows]).reshape(len(rows), width)
    found = []
    for a in {(r[0], r[1], tuple(r[2])): i for i, r in enumerate(rows) if is_anchor(r[0])}.values():
        scores = (vectors @ vectors[a]).astype(int)
        order = sorted(range(len(rows)), key=lambda i: (-scores[i], rows[i][0]))
        near = [i for i in order if rows[i][1] == rows[a][1] and rows[i][0] != rows[a][0]][:positives]
        for p in near:
            hard = [i for i in order if rows[i][1] != rows[a][1]
                    and window[0] * scores[p] <= 100 * scores[i] <= window[1] * scores[p]][:negatives_]
            found += [(rows[a][0], rows[p][0], k + 1, rows[i][0], int(scores[p]), int(scores[i])) for k, i in enumerate(hard)]
    return sorted(found)


def clustered(draw, n, width=6, spread=40):
    centres = [[draw.randint(-200, 200) for _ in range(width)] for _ in range(12)]
    return [[float(x + draw.randint(-spread, spread)) for x in draw.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize("seed,leaf_rows,arity", [(0, 20, 4), (1, 5, 3), (2, 1000, 16), (3, 10, 16)])
def test_agrees_with_brute_force(spark, monkeypatch, seed, leaf_rows, arity):
    draw = random.Random(seed)
    monkeypatch.setattr(negatives, "CHUNK_ROWS", (30, 60))
    rows = [(i - 100, draw.randint(0, 3), v) for i, v in enumerate(clustered(draw, 600))]
    rows += [(1000 + i, i % 2, rows[150][2]) for i in range(200)]  # one vector very often
    table = spark.createDataFrame(rows, VECTORS).repartition(7)
    got = negatives.hard_negatives(table, "vec_id % 20 = 0", sample_rows=200, leaf_rows=leaf_rows, arity=arity)
    assert sorted(tuple(r) for r in got.collect()) == brute_force(rows, lambda i: i % 20 == 0)


def test_tree_leaves_out_leaves_but_no_answer():
    draw = random.Random(5)
    rows = np.array(clustered(draw, 4000, spread=8))
    tree = negatives.Tree(rows[:800], len(rows), 50, 8)
    seen = {}

    def see(node, child, own, away):
        row = seen.setdefault((node, child), {"node": node, "child": child, "least": away.min(0), "greatest": away.max(0),
                                              "low": (own * own).sum(1).min(), "high": (own * own).sum(1).max()})
        assert (row["least"] <= away.min(0)).all()

    leaf = tree.descend(rows, see)
    tree.set_ranges(list(seen.values()))
    anchors = rows[::40]
    scores = anchors @ rows.T
    lows, highs = np.sort(scores, 1)[:, [-5]], np.full((len(anchors), 1), np.inf)
    a, leaves = tree.search(anchors, lows, highs)
    open_ = np.zeros((len(anchors), tree.leaves), bool)
    open_[a, leaves] = True
    for i in range(len(anchors)):
        assert open_[i, leaf[scores[i] >= lows[i, 0]]].all()
    assert open_.mean() < 0.5
    # An annulus: neither the nearest nor the farthest.
    lows, highs = np.sort(scores, 1)[:, [-900]], np.sort(scores, 1)[:, [-800]]
    a, leaves = tree.search(anchors, lows, highs)
    within = np.zeros((len(anchors), tree.leaves), bool)
    within[a, leaves] = True
    for i in range(len(anchors)):
        assert within[i, leaf[(scores[i] >= lows[i, 0]) & (scores[i] <= highs[i, 0])]].all()
    assert within.mean() < 0.8


def test_odd_rows(spark):
    rows = [(0, 1, [3.0, 4.0]), (0, 1, [3.0, 4.0]), (1, 1, [4.0, 4.0]), (1, 1, [4.0, 4.0]), (2, 2, [2.0, 2.0]), (2, 2, [2.0, 2.0]),
            (None, 2, [2.0, 2.0]), (3, None, [2.0, 2.0]), (4, 2, None), (5, 2, [2.0, None]), (6, 2, [2.0, float("nan")]),
            (7, 2, [float("inf"), 1.0]), (8, 2, [5.0]), (9, 2, []), (50, 3, [0.0, 0.0]), (51, 3, [1.0, 1.0])]
    table = spark.createDataFrame(rows, VECTORS)
    for name in ("anchor", "chunk", "code", "row", "leaf", "label_", "is_anchor"):
        table = table.withColumn(name, F.lit("x"))
    got = negatives.hard_negatives(table, F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_force(rows, lambda i: i % 50 == 0)
    assert negatives.hard_negatives(table.limit(0), "vec_id = 0").collect() == []
    assert negatives.hard_negatives(table.where("vec_id = 9"), "vec_id = 9").collect() == []


def test_query_agrees_with_sql(spark):
    folder = "/root/testdata/sf0.01"
    with duckdb.connect() as base:
        base.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
        expected = sorted(base.execute(negatives.SQL).fetchall())
    assert expected and sorted(tuple(r) for r in negatives.gnat_negatives(spark, folder).collect()) == expected
