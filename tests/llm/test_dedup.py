import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import dedup


def shingles(text):
    words = (text or "").encode().split()
    if 0 < len(words) < 5:
        return collections.Counter([tuple(words)])
    return collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def classes(texts):
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "").split() == (texts[j] or "").split()
            if same or alike(texts[i], texts[j]) >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def edited(draw, text, changes):
    words = text.split(" ")
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"x{draw.randint(0, 10**6)}"
    return " ".join(words)


def test_classes_agree_with_brute_force(documents):
    draw = random.Random(5)
    bases = [" ".join(f"{draw.choice('abcdefgh')}{draw.randint(0, 50)}" for _ in range(draw.randint(40, 160))) for _ in range(25)]
    texts = [*bases]
    for base in bases[:12]:
        texts += [edited(draw, base, draw.randint(0, 6)) for _ in range(6)]
    texts += [None, "", " \n", "one two", "one  two", "two one", "a b c d", "a b c d e", "same same " * 300, "same same " * 301]
    texts += [bases[0]] * 5 + [bases[20] + " " + bases[21]]
    draw.shuffle(texts)
    rows = documents(*texts).withColumns({"row": F.lit("mine"), "node": F.lit(1), "times": F.lit(2)})
    got = {r.doc_id: r for r in dedup.near_duplicates(rows).collect()}
    assert [got[i].class_id for i in range(len(texts))] == classes(texts)
    assert all(got[i].kept == (got[i].class_id == i) for i in got)
    left = dedup.one_of_each(rows)
    assert left.columns == rows.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({*classes(texts)})


def test_a_large_group_of_copies_of_one_text(documents):
    draw = random.Random(8)
    base = " ".join(f"w{draw.randint(0, 10**6)}" for _ in range(120))
    texts = [base] + [edited(draw, base, 2) for _ in range(150)] + [base] * 100
    got = dedup.near_duplicates(documents(*texts)).collect()
    assert {r.class_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_texts_that_never_led_are_compared_too(documents, monkeypatch):
    """Edits of one text that are like each other but unlike the leaders of their keys, found after a single round."""
    monkeypatch.setattr(dedup, "ROUNDS", 1)
    draw = random.Random(12)
    base = " ".join(f"w{draw.randint(0, 10**6)}" for _ in range(200))
    texts = [edited(draw, base, 2) for _ in range(40)]
    for _ in range(15):
        texts.append(edited(draw, base, 7))
        texts += [edited(draw, texts[-1], 1), edited(draw, texts[-1], 3)]
    draw.shuffle(texts)
    got = {r.doc_id: r.class_id for r in dedup.near_duplicates(documents(*texts)).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts)


def test_odd_rows(documents, spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    rows = documents((None, long, None, None, None), (3, long + " end", "en", "s", 1), (3, long + " end", "en", "s", 1),
                     (None, "other text here", None, None, None), (None, "other text here", None, None, None), (9, None, "en", "s", 0))
    got = dedup.near_duplicates(rows).collect()
    assert sorted((r.doc_id is None, r.class_id, r.kept) for r in got if r.class_id == 3) == [(False, 3, False), (False, 3, True), (True, 3, False)]
    left = dedup.one_of_each(rows).collect()
    assert sorted((r.doc_id or -1, len(r.text or "")) for r in left) == [(-1, 15), (3, len(long) + 4), (9, 0)]
    empty = rows.where("false")
    assert dedup.near_duplicates(empty).count() == 0 and dedup.one_of_each(empty).count() == 0


@pytest.mark.parametrize("scale", [1.0, 0.3])
def test_signatures_agree_as_often_as_the_weights(scale):
    """Weighted elements, whole numbers or not: the share of equal coordinates is the generalised Jaccard similarity."""
    rng = np.random.default_rng(3)
    n, k = 300, 2000
    element = rng.integers(1, 1 << 62, n).astype(np.uint64)
    a, b = rng.gamma(1.0, 4.0, n) * scale, rng.gamma(1.0, 4.0, n) * scale
    b[:200] = a[:200]
    text = np.repeat([0, 1], n)
    got = dedup.dart_signatures(text, np.concatenate([element, element]), np.concatenate([a, b]), 3, k)
    expected = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert (got[0] == got[1]).mean() == pytest.approx(expected, abs=4 * np.sqrt(expected * (1 - expected) / k))
    assert not got[2].any()


def test_components(spark):
    draw = random.Random(1)
    links = [(i, i + 1) for i in range(100, 130)] + [(7, x) for x in range(200, 260)]
    links += [(draw.randint(300, 340), draw.randint(300, 340)) for _ in range(15)]
    links = [(min(a, b), max(a, b)) for a, b in links if a != b]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = dedup.classes_of(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {x: find(x) for x in parent}
