import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import periods


def brute_runs(words, least=12):
    """Every stretch and period, by definition."""
    found, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            part = words[start:start + 2 * q]
            if length >= max(least, 2 * q) and not any(
                    q % d == 0 and all(part[j] == part[j + d] for j in range(2 * q - d)) for d in range(1, q)):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    dropped = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def some_words(draw, n):
    kind = draw.randrange(5)
    if kind == 0:
        return [draw.choice("ab") for _ in range(n)]
    if kind == 1:
        return ["a"] * n
    words = [draw.choice("abcdefgh") for _ in range(n)]
    for _ in range(draw.randint(1, 4)):
        q, at = draw.randint(1, max(1, n // 3)), draw.randrange(n)
        block = [draw.choice("abc") for _ in range(q)]
        length = draw.randint(q, 5 * q)
        words[at:at + length] = (block * 6)[:len(words[at:at + length])]
    return words


@pytest.mark.parametrize("least", [2, 5, 12])
def test_fragments_are_all_runs(least):
    draw = random.Random(least)
    texts = [some_words(draw, draw.randint(1, 160)) for _ in range(120)]
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    into, left = periods._places(text, len(texts))
    words = np.array([hash(w) & 0xFFFFFFFF for t in texts for w in t], np.uint64)
    got = {i: [] for i in range(len(texts))}
    for i, start, end, period in zip(*periods.fragments(words, text, into, left, least)):
        got[i].append((start, end - start, period))
    for i, words in enumerate(texts):
        assert sorted(got[i], key=lambda r: (r[0], r[2])) == brute_runs(words, least), words


@pytest.mark.parametrize("n,tile,least", [(1, 8, 12), (23, 32, 12), (1000, 32, 12), (5000, 64, 12), (777, 16, 2), (100_000, 4096, 12)])
def test_tiles_share_two_periods_twice_over(n, tile, least):
    seen = {}
    for low, high, begin, end in periods.tile_bounds(n, tile, least):
        seen.setdefault((low, high), []).append((begin, end))
    octaves = [o for pair in sorted(seen) for o in range(*pair)]
    assert octaves == list(range(len(octaves))) and (n < 2 or 2 << len(octaves) > n)
    for (_, high), tiles in seen.items():
        assert tiles[0][0] == 0 and tiles[-1][1] == n
        for (_, end), (begin, _) in zip(tiles, tiles[1:]):
            assert end - begin >= max(least, 2 << high)


def test_tiles_and_whole_texts_agree_with_brute_force(spark, documents):
    draw = random.Random(7)
    texts = [" ".join(some_words(draw, draw.randint(1, 300))) for _ in range(60)]
    texts += [texts[3], texts[3], " ".join(["x"] * 700), " ".join(["x", "y", "z"] * 250) + " x x"]
    table = documents(*texts)
    for whole in (periods.WHOLE_BYTES, 0):  # 0: every text is cut into tiles
        got = {r.doc_id: r for r in periods.collapse_runs(table, whole_bytes=whole, tile_words=32).collect()}
        assert len(got) == len(texts)
        for i, text in enumerate(texts):
            runs = brute_runs(text.split())
            assert [tuple(r) for r in got[i].runs] == runs, text
            assert got[i].collapsed == collapsed(text.split(), runs)


def test_odd_rows(spark):
    rows = [(None, None, "k"), (1, "", "k"), (1, "", "k"), (2, " \t\n ", "r"), (None, "a " * 12, "c"), (3, "é\x0bé " * 7, None),
            (4, "a " * 30, "no break")]
    table = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    table = table.withColumn("key", F.lit(1)).withColumn("collapsed", F.lit(2)).withColumn("words", F.lit(3))
    got = periods.collapse_runs(table).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in got) == [
        (False, 1, [], ""), (False, 1, [], ""), (False, 2, [], ""), (False, 3, [(0, 14, 1)], "é"),
        (False, 4, [], "a " * 30), (True, 0, [], ""), (True, 0, [(0, 12, 1)], "a")]
    assert periods.collapse_runs(table.limit(0)).collect() == []


def test_a_very_long_text(spark, documents):
    draw = random.Random(1)
    block = [str(draw.random()) for _ in range(30_000)]
    text = " ".join(["lead", *block * 3, *block[:77], "end"] + ["w"] * 100_000)
    row = periods.collapse_runs(documents(text)).first()
    assert [tuple(r) for r in row.runs] == [(1, 90_077, 30_000), (90_079, 100_000, 1)]
    assert row.collapsed == " ".join(["lead", *block, "end", "w"])


def test_query_agrees_with_brute_force(spark, tmp_path):
    draw = random.Random(3)
    rows = [(i, " ".join(some_words(draw, draw.randint(0, 120) or 1)) if i % 9 else None) for i in range(250)]
    rows += [(None, "a b " * 10), (5, rows[5][1]), (-7, "q  r\ns " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in periods.periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    expected = []
    for i, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        n, check = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
        g = check // 10
        if check % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (j - a) % p] for j in range(a, n)]
        runs = brute_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        expected.append((
            i, len(runs), *best, best[1] and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(collapsed(words, runs).encode()).hexdigest()))
    assert sum(1 for r in expected if r[1]) > 30
    assert got == sorted(expected, key=repr)
