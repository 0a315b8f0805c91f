import random

import pytest
from pyspark.sql import functions as F

from gleanery.llm import mixing

SIZES = "doc_id long, source string, size long"


def seats_by_quotients(weights, seats, most):
    """The definition: one seat after the other to the highest quotient."""
    got = [0] * len(weights)
    for _ in range(min(seats, sum(most))):
        open_ = [i for i in range(len(weights)) if got[i] < most[i] and weights[i] > 0]
        if not open_:
            break
        best = max(open_, key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


@pytest.mark.parametrize("seed", range(4))
def test_seats_go_to_the_highest_quotients(spark, seed):
    draw = random.Random(seed)
    rows, expected = [], {}
    for group in range(6):
        n = draw.randint(1, 9)
        weights = [draw.choice([0.0, 1.0, 7.5, 7.5, draw.uniform(0, 50)]) for _ in range(n)]
        seats = draw.choice([0, 1, 5, 40, 200])
        most = [draw.choice([1000, draw.randint(0, 8)]) if seed % 2 else 10_000 for _ in range(n)]
        rows += [(group, i, w, seats, m) for i, (w, m) in enumerate(zip(weights, most))]
        expected |= {(group, i): q for i, q in enumerate(seats_by_quotients(weights, seats, most))}
    parties = spark.createDataFrame(rows, "g int, name int, w double, seats long, most long")
    got = mixing.sainte_lague(parties, ["g"], "name", "w", "seats", "most").collect()
    assert {(r.g, r.name): r.quota for r in got} == expected


def filled(sizes, weights):
    """Sharing by weight, again and again, until no target is above its limit."""
    total, limits = sum(sizes), [3 * s for s in sizes]
    at_limit = set()
    while True:
        left = total - sum(limits[i] for i in at_limit)
        open_weight = sum(w for i, w in enumerate(weights) if i not in at_limit)
        share = left / open_weight if open_weight else 0
        over = {i for i, w in enumerate(weights) if i not in at_limit and share * w > limits[i]}
        if not over:
            return [limits[i] if i in at_limit else share * w for i, w in enumerate(weights)]
        at_limit |= over


def test_targets_share_what_others_cannot_take(spark):
    sizes = [5, 0, 1000, 3, 70, 400, 2, 9000]
    names = ["a", "b", "ä", "𝄞", "c", "z", "Z", None]
    rows = [(i, n, s) for i, (n, s) in enumerate(zip(names, sizes))]
    order = sorted(range(8), key=lambda i: (names[i] is None, [ord(c) for c in names[i] or ""]))
    expected = filled([sizes[i] for i in order], [(1, 2, 3)[k % 3] for k in range(8)])
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, SIZES)).collect()}
    assert [got[names[i]] for i in order] == pytest.approx(expected)


def test_taken_words_are_those_of_the_chosen_blocks(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice(["a", "b", "c", None]), draw.choice([0, 1, 5, 300, draw.randint(1, 900)])) for i in range(400)]
    rows += rows[:7]
    got = mixing.mix_plan(spark.createDataFrame(rows, SIZES), shard_words=9000).collect()
    assert len(got) == len(rows)
    for r in got:
        count = lambda b: (b * r.extra + r.offset) // r.n_blocks  # noqa: B023, E731
        extra = sum(count(w // r.block + 1) > count(w // r.block) for w in range(r.start, r.start + r.size))
        assert r.taken == r.rounds * r.size + extra
        assert 0 <= r.taken <= 3 * r.size
    sources = {r.source for r in got}
    for s in sources:
        own = [r for r in got if r.source == s]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.02)
        assert own[0].source_size == sum(r.size for r in own)
    again = mixing.mix_plan(spark.createDataFrame(rows[::-1], SIZES), shard_words=9000).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_texts_of_the_mix(documents):
    text = " ".join(f"w{i}" for i in range(5000))
    rows = documents((0, text, "en", "a", len(text)), (1, "one two\nthree", "en", "b", 13), (2, None, "en", None, None),
                     (3, "", None, "b", 0)).withColumn("size", F.lit("mine"))
    plan = {r.doc_id: r.taken for r in mixing.mix_plan(rows.select(
        "doc_id", "source", F.size(F.split("text", " ")).cast("long").alias("size")).where("doc_id = 0")).collect()}
    made = mixing.mixed(rows)
    assert made.columns == rows.columns and made.where("size != 'mine'").count() == 0
    parts = [r for r in made.collect() if r.doc_id == 0]
    assert all(r.n_chars == len(r.text) for r in parts)
    assert all(w in text.split() for r in parts for w in r.text.split())
    assert plan[0] <= 5000 * 3


def test_empty_table(spark):
    assert mixing.mix_plan(spark.createDataFrame([], SIZES)).count() == 0
