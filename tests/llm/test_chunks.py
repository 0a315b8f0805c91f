import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import chunks, gear
from gleanery.llm import hashing as H


def plain_gear(data):
    made, h = [], 0
    for b in data:
        h = ((h << 1) + int(gear.GEAR[b])) & 0xFFFFFFFF
        made.append(h)
    return made


def prose(draw, words):
    return " ".join("".join(draw.choice("abcdefghiéñ") for _ in range(draw.randint(2, 9))) for _ in range(words))


@pytest.mark.parametrize("n", [0, 1, 5, 31, 32, 33, 500])
def test_gear_hash_is_the_rolling_one(n):
    data = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8)
    assert gear.gear_hashes(data).tolist() == plain_gear(data.tolist())
    assert gear.cuts(data, 3).tolist() == [i + 1 for i, h in enumerate(plain_gear(data.tolist())) if h >> 29 == 0]


def test_valleys_are_least_of_their_neighbourhood():
    data = np.frombuffer(prose(random.Random(4), 300).encode(), np.uint8)
    hashes = plain_gear(data.tolist())
    for reach in (1, 2, 3, 7, 24, 31):
        expected = [i + 1 for i in range(len(data)) if reach < i + 1 <= len(data) - reach
                    and hashes[i] == min(hashes[max(0, i - reach):i + reach + 1])]
        assert gear.valleys(data, reach).tolist() == expected


def test_cuts_resist_insertions():
    draw = random.Random(2)
    text = prose(draw, 400).encode()
    longer = text[:700] + b" inserted words " + text[700:]
    a = {int(c) for c in gear.valleys(np.frombuffer(text, np.uint8), 24)}
    b = {int(c) - (16 if c > 700 else 0) for c in gear.valleys(np.frombuffer(longer, np.uint8), 24)}
    assert len(a ^ b) <= 8 and len(a & b) > 30


def test_chunks_cover_the_text(documents):
    texts = [None, "", "é" * 5000, prose(random.Random(1), 3000), "a" * 10_000, "one two " * 900, "🙂" * 300, "x"]
    for r in chunks.chunked(documents(*texts)).collect():
        text = texts[r.doc_id] or ""
        assert "".join(text[c.start:c.start + c.chars] for c in r.chunks) == text
        assert sum(c.words for c in r.chunks) == len(text.encode().split())


def test_passages_are_found_in_all_their_texts(documents):
    draw = random.Random(7)
    passages = [prose(draw, 60) for _ in range(6)]
    texts = [prose(draw, draw.randint(30, 300)) for _ in range(60)]
    holders = set()
    for k, passage in enumerate(passages):
        for i in draw.sample(range(60), 2 + k):
            at = draw.randrange(len(texts[i]))
            texts[i] = texts[i][:at] + " " + passage + " " + texts[i][at:]
            holders.add(i)
    rows = documents(*texts).withColumns({"row": F.lit("mine"), "n": F.lit(1), "chunks": F.lit(2)})
    got = chunks.repeated_spans(rows).collect()
    assert {r.doc_id for r in got} == holders
    for r in got:
        span = texts[r.doc_id][r.start:r.start + r.n_chars]
        assert span in texts[r.first_doc_id] or any(p in span or span.strip() in p for p in passages)
    assert all(any(r.doc_id == i and r.first for r in got) for i in {r.first_doc_id for r in got})


def test_passages_of_51_words_are_found_up_to_their_ends(documents):
    draw = random.Random(3)
    english = lambda words: " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(words))
    passages = [english(51) for _ in range(120)]
    texts = [f"{english(draw.randint(0, 60))} {p} {english(draw.randint(0, 60))}" for p in passages for _ in range(2)]
    got = {}
    for r in chunks.repeated_spans(documents(*texts)).collect():
        got.setdefault(r.doc_id, []).append(texts[r.doc_id][r.start:r.start + r.n_chars])
        assert r.n_words == len(got[r.doc_id][-1].split())
    assert all(any(passages[i // 2] in span for span in got.get(i, [])) for i in range(len(texts)))


def test_odd_rows(documents):
    draw = random.Random(9)
    long = prose(draw, 100_000)
    rows = documents((None, long, None, None, None), (1, long[1000:], "en", "s", 1), (2, None, "en", "s", 0), (3, "", "en", "s", 0),
                     (4, prose(draw, 80), "en", "s", 0), (5, "short text", "en", "s", 0), (6, "short text", "en", "s", 0))
    rows = rows.unionByName(rows.where("doc_id = 4"))
    got = chunks.repeated_spans(rows).collect()
    assert {r.doc_id for r in got} == {None, 1, 4}
    assert sum(r.n_words for r in got if r.doc_id == 1) > 99_000
    assert sorted(r.first for r in got if r.doc_id == 4) == [False, True]
    alone = documents("the same words again and again " * 400, "nothing of that kind")
    assert chunks.repeated_spans(alone).count() == 0
    assert chunks.repeated_spans(rows.where("false")).count() == 0


def test_digests_differ_in_both_halves():
    data = b"abcabd"
    texts = H.Texts(np.frombuffer(data, np.uint8), np.array([0, 3, 6]))
    sums = H.prefix_sums(texts.data)
    one = H.span_hashes(sums, np.array([0, 3]), np.array([3, 6]))
    same = H.span_hashes(sums, np.array([0, 3]), np.array([2, 5]))
    assert one[0] != one[1] and same[0] == same[1]
