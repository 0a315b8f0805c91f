import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import fingerprint


def jaccard(a, b):
    a, b = (collections.Counter(x.encode().split()) for x in (a, b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_edited_texts_and_likeness(documents, spark):
    draw = random.Random(4)
    texts = [" ".join(draw.choice(["a", "b", "the", f"w{draw.randint(0, 90)}"]) for _ in range(draw.randint(0, 200))) for _ in range(250)]
    texts += [None, "", "é🙂" * 7, "x y z", "x  y\nz", "abc"]
    ids = draw.sample(range(-10**6, 10**6), len(texts) - 1) + [10**15]
    rows = documents(*[(i, t, "en", "s", 0) for i, t in zip(ids, texts)]).withColumns({"chunk": F.lit("mine"), "place": F.lit(1)})
    got = {r.doc_id: r for r in fingerprint.fingerprints(rows).collect()}
    order = sorted(zip(ids, [t or "" for t in texts]))
    errors = []
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        n = len(text) // 4
        edited = text[:len(text) - n] + after[:n]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if text.split() and after.split():
            errors += [got[i].near_edited - jaccard(text, edited), got[i].near_next - jaccard(text, after)]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.08
    by_text = {t: got[i].fingerprint for i, t in order}
    assert by_text["x y z"] == by_text["x  y\nz"] and len({*by_text.values()}) >= len(by_text) - 3


@pytest.mark.parametrize("draws", [4000])
def test_collision_rate_is_the_generalised_similarity(spark, draws):
    """Real weights, many pairs: the mean likeness against the weights' similarity."""
    rng = np.random.default_rng(1)
    rows, expected = [], []
    for pair in range(60):
        a, b = rng.gamma(1.0, 3.0, 40), rng.gamma(1.0, 3.0, 40)
        b[:20] = a[:20]
        expected.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
        for side, weights in ((0, a), (1, b)):
            rows += [(pair, side, int(pair * 1000 + k) * 7919 + 13, float(w)) for k, w in enumerate(weights)]
    terms = spark.createDataFrame(rows, "pair int, side int, term long, weight double").withColumn("term", F.xxhash64("term"))
    signed = fingerprint.sample_terms(terms, ["pair", "side"])
    both = signed.groupBy("pair").agg(F.max(F.when(F.col("side") == 0, F.col("samples"))).alias("a"),
                                      F.max(F.when(F.col("side") == 1, F.col("samples"))).alias("b"))
    got = [r[0] for r in both.orderBy("pair").select(fingerprint.likeness(F.col("a"), F.col("b"))).collect()]
    assert np.mean(got) == pytest.approx(np.mean(expected), abs=0.03)
    assert np.corrcoef(got, expected)[0, 1] > 0 and np.std(np.array(got) - expected) < 0.09


def test_odd_rows(documents):
    rows = documents((None, "null id", None, None, None), (None, None, None, None, None), (5, "twice", "en", "s", 0),
                     (5, "twice", "en", "s", 0), (6, "word " * 200_000, "en", "s", 0))
    got = fingerprint.fingerprints(rows).collect()
    assert sorted((r.doc_id is None, r.n_chars) for r in got) == [(False, 5), (False, 5), (False, 1_000_000), (True, 0), (True, 7)]
    one = fingerprint.fingerprints(documents("alone here")).first()
    assert one.near_next == 1.0
    assert fingerprint.fingerprints(rows.where("false")).count() == 0


def test_chunks_rise_with_the_key(spark):
    keys = [*range(1000), *range(10**6, 10**6 + 50), 10**17, -5]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    got = [(r.k, r.chunk) for r in fingerprint.in_chunks(rows, "k").orderBy("k").collect()]
    assert [c for _, c in got] == sorted(c for _, c in got)
    assert len({c for _, c in got}) > 20


def test_no_python_runs_on_the_rows(documents):
    plan = fingerprint.fingerprints(documents("a b", "c"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
