import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.llm import hashing as H
from gleanery.llm import toxicity

INSULTS = {"en": ["idiot", "moron", "scum"], "de": ["loweisch", "loweient", "loweiau"]}


def corpus(n=400, seed=1):
    draw = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("tre", "an", "on", "lor") for b in ("ti", "sha", "ver") for c in ("el", "im", "ou", "ga", "ni")]
    rows = []
    for i in range(n):
        lang = draw.choice(["en", "de"])
        text = [draw.choice(words) for _ in range(draw.randint(15, 80))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                text[draw.randrange(len(text))] = draw.choice(INSULTS[lang])
        rows.append((i, " ".join(text), lang, "s", 0, int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame([r[:5] for r in rows], kind), spark.createDataFrame(
        [(r[0], 1, r[5]) for r in rows], "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(tables):
    documents, labels = tables
    out = toxicity.held_out(F.col("doc_id"))
    got = toxicity.classify(documents, labels.where(~out)).join(labels, "doc_id").where(out).collect()
    assert len(got) > 80
    assert np.mean([(r.score >= 0.7) == (r.toxic == 1) for r in got]) > 0.97
    assert np.mean([r.rejected == (r.toxic == 1) for r in got]) > 0.97


def test_a_score_depends_on_the_text_alone(tables):
    documents, labels = tables
    moved = documents.select((F.col("doc_id") + 10_000).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit(None).alias("source"))
    model, _ = toxicity.fit(documents, labels)
    a = toxicity.scored(documents, model, ("doc_id",)).collect()
    b = toxicity.scored(moved, model, ("doc_id",)).collect()
    assert {r.doc_id: r.score for r in a} == {r.doc_id - 10_000: r.score for r in b}


def test_batches_do_not_matter():
    model = toxicity.train([r[1] for r in corpus(60)], np.array([r[5] for r in corpus(60)], float))
    texts = ["", "idiot", "a", "tretiel " * 5, "idiot " * 400, "é"]
    data = [t.encode() for t in texts]
    together = H.Texts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    alone = [H.Texts(np.frombuffer(d, np.uint8), np.array([0, len(d)])) for d in data]
    assert toxicity.logits(model, *toxicity.token_ids(together)) == pytest.approx(
        np.concatenate([toxicity.logits(model, *toxicity.token_ids(t)) for t in alone]), abs=1e-5)


def test_scoring_holds_little_at_a_time():
    """Every worker of an executor needs the same beside the others: what a large batch takes is bounded."""
    texts = pa.array(["tretiel idiot, onshaim " * 100] * 2000)  # 4.6 MB
    learner, _ = toxicity._start(np.full((2, toxicity.BUCKETS), 5), 100, 100, np.random.default_rng(0))
    tracemalloc.start()
    for _, _, part in H.slices(texts):
        toxicity.logits(learner.model(), *toxicity.token_ids(part))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 40 << 20


def test_odd_rows(tables, spark):
    documents, labels = tables
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (900, "", "en", "s", 0), (901, "treel " * 300_000, "zz", None, 0), (5, "same id", "en", "s", 0)],
        documents.schema).withColumns({"score": F.lit("mine"), "rejected": F.lit(1)})
    extra = spark.createDataFrame([(None, 1, 1), (5, None, None), (5, 0, 1), (5, 0, 1)], labels.schema)
    rows = documents.withColumns({"score": F.lit("mine"), "rejected": F.lit(1)}).unionByName(odd)
    got = toxicity.classify(rows, labels.unionByName(extra))
    assert got.count() == 404 and got.where("score < 0 OR score > 1 OR score IS NULL OR rejected IS NULL").count() == 0
    kept = toxicity.without_toxic(rows, labels.unionByName(extra))
    assert kept.columns == rows.columns and 200 < kept.count() < 320
    one_class = toxicity.classify(rows, labels.where("toxic = 0"))
    assert one_class.where("score != 0 OR rejected").count() == 0
    assert toxicity.classify(rows.where("false"), labels).count() == 0


def test_all_labelled_documents_are_learnt_from(spark, monkeypatch):
    """A word that one in a few hundred documents has is learnt, whatever the size of a task's part."""
    monkeypatch.setattr(toxicity, "TASK_DOCUMENTS", 400)
    draw = random.Random(4)
    rows = []
    for i in range(9000):
        toxic = i % 300 == 0
        rows.append((i, " ".join([f"w{draw.randint(0, 60)}" for _ in range(6)] + ["insult"] * toxic), "en", "s", 0, int(toxic)))
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    documents = spark.createDataFrame([r[:5] for r in rows], kind).repartition(6)
    labels = spark.createDataFrame([(r[0], 1, r[5]) for r in rows], "doc_id long, quality int, toxic int")
    counted = []
    start = toxicity._start
    monkeypatch.setattr(toxicity, "_start", lambda by_class, clean, toxic, rng: counted.append((clean, toxic)) or start(by_class, clean, toxic, rng))
    model, _ = toxicity.fit(documents, labels)
    assert 7000 < counted[0][0] < 7400 and 15 <= counted[0][1] <= 30
    got = toxicity.scored(documents, model, ("doc_id",)).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 300 == 0) for r in got]) > 0.999


def test_languages_get_the_middle_of_their_gap():
    score = np.array([0.9] * 20 + [0.8] * 20 + [0.99] * 20 + [0.1] * 20)
    toxic = np.array([1] * 20 + [0] * 20 + [1] * 20 + [0] * 20)
    lang = np.array(["de"] * 40 + ["en"] * 40, dtype=object)
    found = toxicity._thresholds(score, toxic, lang)
    assert found["de"] == pytest.approx(0.85) and found["en"] == 0.7
    assert toxicity._thresholds(score[:10], toxic[:10], lang[:10]) == {}
