import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gleanery.llm.text import stored

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(12)
    words = [a + b for a in ("tre", "an", "on", "lor", "vi") for b in ("ti", "sha", "ver", "el", "ou")]
    rows, labels = [], []
    for i in range(240):
        text = [draw.choice(words) + str(draw.randint(0, 99)) for _ in range(draw.randint(40, 90))]
        toxic = i % 6 == 0
        if toxic:
            text[5], text[20] = "idiot", "moron"
        if i % 5 == 1:
            text[7] = "password=" + "".join(draw.choice("0123456789abcdef") for _ in range(18))
        if i % 5 == 2:
            text[7] = "".join(draw.choice("0123456789") for _ in range(16))
        rows.append((i, " ".join(text), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(300 + i, rows[i][1] + " more", "en", "s0", 0) for i in range(1, 30) if i % 6]
    rows += [(400, None, None, None, None), (401, "", "en", "s1", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCUMENTS).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    library = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    before = {r.doc_id: r for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), f"test-{name}")
        seen[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == columns
    toxic = {r.doc_id for r in seen["toxicity"]}
    assert toxic == {i for i, r in before.items() if "idiot" not in (r.text or "")}
    single = {r.doc_id for r in seen["near_duplicates"]}
    assert single == {i for i in toxic if not 300 < i < 400 and i != 401}
    for r in seen["secrets"]:
        assert "password=" not in (r.text or "") or "password=[SECRET]" in r.text
        assert (r.text or "").count("[SECRET]") == (before[r.doc_id].text or "").count("password=")
    total = sum(len((r.text or "").split()) for r in seen["secrets"])
    taken = {s: sum(len(r.text.split()) for r in seen["mixing"] if r.source == s) for s in ("s0", "s1", "s2")}
    for k, s in enumerate(("s0", "s1", "s2")):
        assert taken[s] == pytest.approx(total * (k + 1) / 6, rel=0.06)
    texts = {}
    for r in seen["mixing"]:
        texts.setdefault(r.doc_id, []).append(r.text)
    for r in seen["bpe"]:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.n_tokens
        assert any(library.encode(t, add_special_tokens=False).ids == ids for t in texts[r.doc_id])


def test_run_is_the_stages_in_order(spark, folder, tmp_path):
    result = corpus_pipeline.run(spark, folder)
    assert result.count() > 100 and result.where("n_tokens != length(ids) / 4").count() == 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
