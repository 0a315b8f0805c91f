import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from gleanery.llm import blocks
from gleanery.llm import hashing as H
from gleanery.llm import lm, text

END = "\0end"


def tokens(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), END]


class Backoff:
    """The model by its definition, with dictionaries."""

    def __init__(self, texts):
        lists = [tokens(t) for t in texts]
        self.one = collections.Counter(w for x in lists for w in x)
        two = collections.Counter(p for x in lists for p in zip(x, x[1:]))
        three = collections.Counter(p for x in lists for p in zip(x, x[1:], x[2:]))
        self.two = {k: n for k, n in two.items() if n >= lm.FEWEST}
        self.three = {k: n for k, n in three.items() if n >= lm.FEWEST}
        self.n, self.v = sum(self.one.values()), len(self.one)

    def p1(self, w):
        return (self.one[w] + 1) / (self.n + self.v + 1)

    def p2(self, h, w):
        if (h, w) in self.two:
            return (self.two[h, w] - lm.DISCOUNT) / self.one[h]
        own = [k[1] for k in self.two if k[0] == h]
        if not own:
            return self.p1(w)
        rest = 1 - sum((self.two[h, x] - lm.DISCOUNT) / self.one[h] for x in own)
        return rest / (1 - sum(map(self.p1, own))) * self.p1(w)

    def p3(self, g, h, w):
        if (g, h, w) in self.three:
            return (self.three[g, h, w] - lm.DISCOUNT) / self.two[g, h]
        own = [k[2] for k in self.three if k[:2] == (g, h)]
        if not own:
            return self.p2(h, w)
        rest = 1 - sum((self.three[g, h, x] - lm.DISCOUNT) / self.two[g, h] for x in own)
        return rest / (1 - sum(self.p2(h, x) for x in own)) * self.p2(h, w)

    def score(self, text):
        x = tokens(text)
        total = 0.0
        for i, w in enumerate(x):
            p = self.p1(w) if i == 0 else self.p2(x[i - 1], w) if i == 1 else self.p3(x[i - 2], x[i - 1], w)
            total += math.log10(p)
        return total


def corpus(n=60, seed=2):
    draw = random.Random(seed)
    return [" ".join(draw.choice(["The", "cat", "sat", "on", "a", "mat", f"w{draw.randint(0, 400)}"]) for _ in range(draw.randint(0, 60)))
            for _ in range(n)]


@pytest.mark.parametrize("head", [1 << 19, 12])
def test_scores_agree_with_the_definition(documents, monkeypatch, head):
    """With room for all words, and with most words left to the join."""
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    monkeypatch.setattr(lm, "PIECE", 7)
    texts = [*corpus(), None, "", "\n", "unseen words only", "the " * 900]
    rows = documents(*texts, texts[0]).withColumns({"score": F.lit("mine"), "rare": F.lit(1)})
    out = lm.held_out(F.col("doc_id"))
    got = lm.score_documents(rows, rows.where(~out)).collect()
    texts.append(texts[0])
    assert len(got) == len(texts)
    model = Backoff([t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2])
    if head == 12:  # n-grams are made of the frequent words
        frequent = {w for w, n in model.one.most_common(12)}
        known = _kept_words(model, 12)
        assert known <= frequent or len(known) <= 12
        model.two = {k: n for k, n in model.two.items() if set(k) <= known}
        model.three = {k: n for k, n in model.three.items() if set(k) <= known}
    for r in got:
        x = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(model.one[w] > 0 for w in x), model.n)
        assert r.base_score == pytest.approx(sum(math.log10(model.p1(w)) for w in x))
        assert r.score == pytest.approx(model.score(texts[r.doc_id]))


@pytest.mark.parametrize("words,grams", [(12, 5), (100, 40), (3, 0)])
def test_what_the_automaton_has_no_room_for_counts_all_the_same(documents, monkeypatch, words, grams):
    """N-grams of rare words and rare n-grams have their probabilities, by a join."""
    for name, bound in (("AUTOMATON_WORDS", words), ("KEPT_NGRAMS", grams), ("PIECE", 7), ("SIEVE", 1 << 10)):
        monkeypatch.setattr(lm, name, bound)
    texts = [*corpus(), *["one rare phrase w1 the cat sat"] * 4, None, "", "unseen words only", "the " * 90]
    rows = documents(*texts)
    got = lm.score_documents(rows, rows.where(~lm.held_out(F.col("doc_id")))).collect()
    model = Backoff([t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2])
    assert len(got) == len(texts) and len(model.two) > 30 and len(model.three) > 20
    for r in got:
        x = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(model.one[w] > 0 for w in x), model.n)
        assert r.base_score == pytest.approx(sum(math.log10(model.p1(w)) for w in x))
        assert r.score == pytest.approx(model.score(texts[r.doc_id]))


def _kept_words(model, bound):
    """All words from a count upwards, the counts taken in steps of a 16th power of two."""
    step = lambda n: math.floor(math.log2(n) * 16)
    sizes = collections.Counter(step(n) for n in model.one.values())
    total, lowest = 0, math.inf
    for s in sorted(sizes, reverse=True):
        if total + sizes[s] > bound:
            break
        total, lowest = total + sizes[s], s
    return {w for w, n in model.one.items() if step(n) >= lowest}


def test_probabilities_of_every_state_add_up_to_one():
    model = Backoff(corpus())
    words = list(model.one)
    unseen = model.p1("never seen")
    for g, h in [*list(model.two)[:20]]:
        assert sum(model.p3(g, h, w) for w in words) + model.p2(h, "never seen") * 0 <= 1 + 1e-9
        assert sum(model.p2(h, w) for w in words) <= 1 + 1e-9
    assert sum(map(model.p1, words)) + unseen == pytest.approx(1)


def test_no_training_text_and_empty_table(documents):
    rows = documents("a b", None)
    got = lm.score_documents(rows, rows.where("false")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in got] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert lm.score_documents(rows.where("false"), rows).count() == 0


def test_long_text_in_pieces(documents):
    text = "the cat sat on the mat " * 40_000
    rows = documents(text, "the cat")
    got = lm.score_documents(rows, rows).orderBy("doc_id").collect()
    model = Backoff([text, "the cat"])
    assert got[0].score == pytest.approx(model.score(text), rel=1e-6)


def test_hashes_depend_on_the_word_alone():
    data = "Über the É\nthe".encode()
    one, starts = lm.token_hashes(H.Texts(np.frombuffer(data, np.uint8), np.array([0, len(data)])))
    other = b"the"
    two, _ = lm.token_hashes(H.Texts(np.frombuffer(other * 2, np.uint8), np.array([0, 3, 6])))
    assert starts.tolist() == [0, 5] and one[1] == one[3] == two[0] == two[2] and one[4] == two[1] == lm.END


@pytest.mark.parametrize("values", [[], [0], [5, 5, 300, 1 << 40, (1 << 62) + 1], [-3, -1, 0, 7], [9, 2, 1 << 33]])
def test_blocks_give_their_numbers_back(values):
    values = np.array(values, np.int64)
    assert blocks.unpack(blocks.pack(values)).tolist() == values.tolist()
    assert blocks.unpack_sorted(blocks.pack_sorted(values)).tolist() == values.tolist()


def test_counts_go_through_the_shuffle_in_few_bytes():
    """Distinct pairs of a lot, in order, with their counts: rows of three numbers took 11 bytes each."""
    draw = np.random.default_rng(1)
    words = np.minimum((1 / draw.random((2, 1 << 20)) ** 0.9).astype(np.int64), (1 << 19) - 1)
    ids, times = np.unique(lm.longer(words[0], words[1]), return_counts=True)
    order, begin = lm.parted(ids, 16)
    size = sum(len(blocks.pack_sorted(ids[order[a:b]])) + len(blocks.pack(times[order[a:b]] - 1)) for a, b in zip(begin, begin[1:]))
    assert size < 5 * len(ids)


def test_parts_are_the_same_in_tasks_and_in_columns(spark):
    ids = np.array([0, 1, (1 << 40) + 5, (1 << 60) + 12345678901, -1, -(1 << 62) + 99, 1 << 20], np.int64)
    order, begin = lm.parted(ids, 7)
    part = np.empty(len(ids), int)
    part[order] = np.repeat(np.arange(7), np.diff(begin))
    rows = spark.createDataFrame([(int(x),) for x in ids], "id long").select("id", lm.part_of(7).alias("part")).collect()
    assert {r.id: r.part for r in rows} == dict(zip(ids.tolist(), part.tolist()))


def test_ngrams_of_many_parts_and_lots(documents, monkeypatch):
    monkeypatch.setattr(lm, "GATHERED", 100)
    monkeypatch.setattr(lm, "PART_TOKENS", 20)
    monkeypatch.setattr(lm, "AUTOMATON_WORDS", 20)
    monkeypatch.setattr(lm, "KEPT_NGRAMS", 10)
    texts = corpus(80, 5)
    rows = documents(*texts)
    model = Backoff(texts)
    for r in lm.score_documents(rows, rows).collect():
        assert r.score == pytest.approx(model.score(texts[r.doc_id]))


def test_nothing_shuffled_is_left_once_a_table_is_stored(spark, monkeypatch, tmp_path):
    """The write runs with Spark's clean-up of shuffle files; what the session had set stays."""
    seen = []
    monkeypatch.setattr(text, "scratch_path", lambda session, name: str(tmp_path / name))
    write = DataFrameWriter.parquet
    monkeypatch.setattr(
        DataFrameWriter, "parquet", lambda self, *a, **b: seen.append(spark.conf.get(text.SHUFFLES_GO)) or write(self, *a, **b))
    before = spark.conf.get(text.SHUFFLES_GO)
    assert text.stored(spark.range(9).groupBy("id").count(), "counted").count() == 9
    assert seen == ["true"] and spark.conf.get(text.SHUFFLES_GO) == before


def test_only_the_values_and_the_rounds_are_left_on_disk(spark, documents, monkeypatch, tmp_path):
    """Counts and tables on the way go; places of one round of documents at a time are shuffled."""
    monkeypatch.setattr(text, "scratch_path", lambda session, name: str(tmp_path / "gleanery" / f"{name}-{len(made)}-{made.append(name)}"))
    made = []
    texts = [*corpus(), *["the cat"] * 5, None]
    rows = documents(*texts)
    assert len(lm.score_documents(rows, rows).collect()) == len(texts)
    left = sorted(p.name.rsplit("-", 2)[0] for p in (tmp_path / "gleanery").iterdir())
    assert left == ["lm-others", *["lm-scored"] * lm.ROUNDS]
    with pytest.raises(ValueError):
        outside = str(tmp_path / "table")
        rows.write.parquet(outside)
        text.drop(spark.read.parquet(outside))


@pytest.mark.parametrize("n", [0, 1, 2, 5_000])
def test_words_are_found_by_their_first_bits(n):
    draw = np.random.default_rng(n)
    hashes = np.unique(draw.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
    hashes[:n // 2] >>= np.uint64(25)  # many with the same first bits
    hashes = np.unique(hashes)
    head = lm.head_of(hashes, draw.integers(1, 9, len(hashes)))
    rank = dict(zip(hashes.tolist(), head.rank.tolist()))
    asked = np.concatenate([hashes, hashes + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)])
    assert lm.number_words(head, asked).tolist() == [rank.get(x, -1) for x in asked.tolist()]
    assert sorted(rank.values()) == list(range(len(hashes)))
