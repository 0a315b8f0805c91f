"""Periodic runs of words by scale-tiled distribution: tiles per octave of periods, boundary Z-functions, stitching.

A run is a stretch of words that repeats with some smallest period at least twice and that cannot be made longer.
Long texts are cut into overlapping tiles, longer ones for each further octave of periods, and the tiles are solved
apart from one another; a tile finds every run inside it.  What it says of a run that goes on beyond the tile is a
fragment.  Neighbouring tiles share so many words that fragments of one run share at least one period, so after a
shuffle by text and period overlapping fragments are put together.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm import hashing as H
from gleanery.llm.registry import query, table
from gleanery.llm.text import SPACE, stored, word_count
from gleanery.operators.joins import broadcast_if_small

# Shortest run; every run also holds its period twice.
LEAST_WORDS = 12
# Texts up to so many bytes are one tile each; longer ones are cut into tiles of so many words.
WHOLE_BYTES = 1 << 15
TILE_WORDS = 1 << 12
# Comparisons held in memory at once, and words solved together.
BLOCK = 1 << 20
LOT_WORDS = 1 << 18
_NAME = np.uint64(0x9FB21C651E98DF25)

RUNS = "array<struct<start: long, length: long, period: long>>"


def _lone(first: int, n: int) -> np.ndarray:
    """Names that no two places share."""
    return H.mix(np.arange(first, first + n, dtype=np.uint64) ^ np.uint64(0xA5A5_5A5A_C3C3_3C3C))


def _joined(names: np.ndarray, by: int, gram: int, left: np.ndarray) -> np.ndarray:
    """Names of the grams made of a gram and the one ``by`` words later; a gram that leaves its text is like no other."""
    made = _lone(0, len(names))
    if by < len(names):
        both = H.mix(names[:len(names) - by] * _NAME + names[by:])
        whole = left[:len(both)] >= gram
        made[:len(both)][whole] = both[whole]
    return made


@functools.lru_cache(1 << 16)
def _primes(n: int) -> tuple[int, ...]:
    found, d = [], 2
    while d * d <= n:
        if n % d == 0:
            found.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return (*found, n) if n > 1 else tuple(found)


def _agreeing(words: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``a`` and ``b`` on, going by ``step``, are the same; ``limit`` at most."""
    got = np.zeros(len(a), np.int64)
    active = np.flatnonzero(limit > 0)
    while len(active):
        ahead = got[active, None] + np.arange(32)
        inside = ahead < limit[active, None]
        one = np.where(inside, a[active, None] + step * ahead, 0)
        two = np.where(inside, b[active, None] + step * ahead, 0)
        same = (words[one] == words[two]) & inside
        run = np.where(same.all(1), 32, same.argmin(1))
        got[active] += run
        active = active[(run == 32) & (got[active] < limit[active])]
    return got


def _boundary_hits(names: np.ndarray, gram: int, octave: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundary numbers and periods of an octave where the Z-function of the boundary reaches ``gram``.

    Boundaries lie ``gram`` words apart, so a Z-function that goes on beyond the next boundary does so there as well.
    """
    padded = np.concatenate([names, _lone(1 << 40, 2 * octave)])
    later = np.lib.stride_tricks.sliding_window_view(padded, octave)[octave:octave + len(names):gram]
    here = names[::gram]
    rows = max(1, BLOCK // octave)
    found = []
    for first in range(0, len(here), rows):
        row, column = np.nonzero(later[first:first + rows] == here[first:first + rows, None])
        found.append((row + first, column + octave))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _has_smaller_period(names: np.ndarray, gram: int, start: np.ndarray, period: np.ndarray, least: int) -> np.ndarray:
    """Whether a part of the period is a period of what begins at ``start``: all divisors by one prime are tried."""
    unique, at = np.unique(period, return_inverse=True)
    primes = [_primes(int(q)) for q in unique]
    smaller = np.zeros(len(period), bool)
    for slot in range(max(map(len, primes), default=0)):
        prime = np.array([p[slot] if slot < len(p) else 0 for p in primes], np.int64)[at]
        tried = np.flatnonzero(prime)
        part = period[tried] // prime[tried]
        # A stretch of two periods that is periodic by the part is so everywhere; grams cover it.
        stretch = np.maximum(least, 2 * period[tried]) - part
        alike = np.ones(len(tried), bool)
        for n in range(int((stretch.max() - 1) // gram + 1) if len(tried) else 0):
            here = start[tried] + np.minimum(n * gram, stretch - gram)
            alike &= names[here] == names[here + part]
        smaller[tried] |= alike
    return smaller


def fragments(
    words: np.ndarray, text: np.ndarray, into: np.ndarray, left: np.ndarray, least: int, octaves: tuple[int, int] = (0, 64),
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, end and period of all runs with a period from ``2 ** octaves[0]`` to below ``2 ** octaves[1]``.

    ``words`` are the hashes of the words of several texts, ``text`` the text of each, ``into`` and ``left`` how many
    words of it come before and from there on.
    """
    found = []
    power, names = 1, words
    for k in range(64):
        octave = 1 << k
        long = into + left >= 2 * octave
        if k >= octaves[1] or not long.any():
            break
        if 2 * long.sum() < len(long):  # only texts that can hold such a period
            words, text, into, left, names = words[long], text[long], into[long], left[long], names[long]
        # A run's matches are a stretch of max(period, least - period) words or more: some boundary's gram lies in it.
        # Grams never get shorter from octave to octave.
        stretch = min(max(q, least - q) for q in range(octave, max(octave + 1, least)))
        gram = (stretch + 1) // 2
        while 2 * power <= gram:
            names = _joined(names, power, 2 * power, left)
            power *= 2
        if k < octaves[0]:
            continue
        grams = names if gram == power else _joined(names, gram - power, gram, left)
        row, period = _boundary_hits(grams, gram, octave)
        same_text = left[row * gram] >= period + gram
        row, period = row[same_text], period[same_text]
        if not len(row):
            continue
        order = np.lexsort((row, period))
        row, period = row[order], period[order]
        # Neighbouring boundaries that match at one period lie in one stretch of matches.
        new = np.ones(len(row), bool)
        new[1:] = (period[1:] != period[:-1]) | (row[1:] != row[:-1] + 1)
        at = np.flatnonzero(new)
        period, first = period[at], row[at] * gram
        last = row[np.append(at[1:], len(row)) - 1] * gram + gram
        first = first - _agreeing(words, first - 1, first - 1 + period, into[first].astype(np.int64), -1)
        beyond = left[first] - (last - first) - period
        last = last + _agreeing(words, last, last + period, beyond.astype(np.int64), 1)
        kept = last - first >= np.maximum(period, least - period)
        first, last, period = first[kept], last[kept], period[kept]
        kept = ~_has_smaller_period(grams, gram, first, period, least)
        first, last, period = first[kept], last[kept], period[kept]
        start = into[first].astype(np.int64)
        found.append((text[first], start, start + (last - first) + period, period))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(part).astype(np.int64) for part in zip(*found))


def _places(text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(text, minlength=n)
    starts = np.cumsum(counts) - counts
    into = np.arange(len(text)) - starts[text]
    return into, counts[text] - into


def _as_batch(keys: pa.Array, found: tuple) -> pa.RecordBatch:
    text, start, end, period = found
    return pa.RecordBatch.from_pydict(
        {"key": keys.take(pa.array(text)), "start": start, "end": end, "period": period})


def _solve_whole(least: int):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, texts in H.slices(batch.column("text")):
                words = H.runs(texts)
                into, left = _places(words.text, len(texts))
                found = fragments(words.hash, words.text, into, left, least)
                yield _as_batch(batch.column("key").slice(first, stop - first), found)

    return solve


def tile_bounds(n: int, tile_words: int, least: int) -> Iterator[tuple[int, int, int, int]]:
    """First and last octave, begin and end of the tiles of ``n`` words.

    A tile shares with the next as many words as two of its longest periods, twice over.
    """
    shared = max(least, tile_words // 4)
    low = 0
    while 2 << low <= n:
        high = max(low + 1, (shared // 4).bit_length())
        step = max(tile_words - shared, 2 * shared)
        for begin in range(0, max(1, n - shared), step):
            yield low, high, begin, min(n, begin + step + shared)
        low, shared = high, max(least, 4 << high)


def _explode(tile_words: int, least: int):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One text after the other: each may be long.
            for i in range(len(batch)):
                for _, _, texts in H.slices(batch.column("text").slice(i, 1)):
                    words = H.runs(texts).hash
                    for low, high, begin, end in tile_bounds(len(words), tile_words, least):
                        yield pa.RecordBatch.from_pydict({
                            "key": batch.column("key").slice(i, 1), "low": pa.array([low], pa.int32()),
                            "high": pa.array([high], pa.int32()), "begin": pa.array([begin], pa.int64()),
                            "words": pa.array([words[begin:end].tobytes()], pa.binary())})

    return explode


def _solve_tiles(least: int):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = list(zip(batch.column("low").to_pylist(), batch.column("high").to_pylist()))
            for octaves in sorted(set(of)):
                lot, size = [], 0
                rows = [i for i, o in enumerate(of) if o == octaves]
                for i in rows:
                    lot.append(i)
                    size += len(batch.column("words")[i].as_buffer()) // 8
                    if size < LOT_WORDS and i != rows[-1]:
                        continue
                    parts = [np.frombuffer(batch.column("words")[j].as_buffer(), np.uint64) for j in lot]
                    text = np.repeat(np.arange(len(lot)), [len(p) for p in parts])
                    into, left = _places(text, len(lot))
                    tile, start, end, period = fragments(np.concatenate(parts), text, into, left, least, octaves)
                    picked = batch.take(pa.array(lot))
                    begin = picked.column("begin").to_numpy()[tile]
                    yield _as_batch(picked.column("key"), (tile, start + begin, end + begin, period))
                    lot, size = [], 0

    return solve


def stitched(found: DataFrame) -> DataFrame:
    """Whole runs of fragments ``key, start, end, period``: those that share a period of words are one."""
    found = found.distinct()
    order = Window.partitionBy("key", "period").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") > reach - F.col("period")).cast("int"), F.lit(1))
    found = found.withColumn("new", new)
    found = found.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return found.groupBy("key", "period", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def runs_of_texts(
    texts: DataFrame, least: int = LEAST_WORDS, whole_bytes: int = WHOLE_BYTES, tile_words: int = TILE_WORDS,
) -> DataFrame:
    """``key`` and ``runs`` of every text in ``(key, text)`` that has runs, ordered by start, then period.

    ``key`` is binary and the same for equal texts only.  Long texts' tiles are dealt out over all tasks.
    """
    kind = "key binary, start long, end long, period long"
    size = F.octet_length("text")
    short = texts.where(size <= whole_bytes).mapInArrow(_solve_whole(least), kind)
    tiles = texts.where(size > whole_bytes).mapInArrow(
        _explode(tile_words, least), "key binary, low int, high int, begin long, words binary")
    tiles = tiles.repartition("key", "low", "begin").mapInArrow(_solve_tiles(least), kind)
    found = stitched(short.unionByName(tiles))
    run = F.struct("start", (F.col("end") - F.col("start")).alias("length"), "period")
    return found.groupBy("key").agg(F.sort_array(F.collect_list(run)).alias("runs"))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        collapsed = []
        for text, runs in zip(batch.column("text"), batch.column("runs")):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            if runs.is_valid and len(runs):
                dropped = np.zeros(len(words) + 1, np.int64)
                start, length, period = (runs.values.field(n).to_numpy() for n in ("start", "length", "period"))
                np.add.at(dropped, start + period, 1)
                np.add.at(dropped, start + length, -1)
                words = itertools.compress(words, np.cumsum(dropped) == 0)
            collapsed.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(collapsed, pa.binary()).cast(pa.string())], names=[*batch.schema.names, "collapsed"])


def collapse_runs(
    documents: DataFrame, text: str = "text", least: int = LEAST_WORDS, whole_bytes: int = WHOLE_BYTES,
    tile_words: int = TILE_WORDS,
) -> DataFrame:
    """``doc_id, runs, collapsed`` of every row: all runs of its words, and its text with each run's first period only.

    Runs are ``start, length, period`` in words, by start and period; a run has ``least`` words or more and its smallest
    period at least twice.  ``collapsed`` joins the words that are left with single spaces.  Null and empty texts have no
    runs and collapse to nothing; equal texts share their runs; repeated rows and null ids keep their rows; other columns
    are ignored; an empty table gives an empty one.
    """
    rows = documents.select("doc_id", F.col(text).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5("text")))
    found = stored(runs_of_texts(rows.select("key", "text").where("text IS NOT NULL"), least, whole_bytes, tile_words), "runs")
    # Without a broadcast, adaptive execution splits the key of a text that many rows have.
    found = broadcast_if_small(found, found.select(F.to_json("runs").alias("runs")))
    known = rows.join(found, "key", "left").select("doc_id", "text", "runs")
    kind = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, text string, runs {RUNS}"
    made = known.mapInArrow(_collapse, f"{kind}, collapsed string")
    return made.select("doc_id", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"), "collapsed")


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """``doc_id, text`` where a tenth of the texts, by a checksum of the id, repeat a stretch of words to their end."""
    check = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n = word_count(F.col("text"))
    rows = documents.select("doc_id", "text", F.floor(check / 10).alias("g"), ((check % 10 == 0) & (n > 0)).alias("planted"))
    words = F.filter(F.split("text", f"{SPACE}+"), lambda w: w != "")
    rows = rows.withColumn("words", F.when(F.col("planted"), words)).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rows = rows.withColumn("block", F.slice("words", F.col("a") + 1, F.col("p")))
    times, rest = F.floor((F.col("n") - F.col("a")) / F.col("p")).cast("int"), (F.col("n") - F.col("a")) % F.col("p")
    made = F.concat(F.slice("words", F.lit(1), F.col("a")), F.flatten(F.array_repeat("block", times)),
                    F.slice("block", F.lit(1), rest))
    return rows.select("doc_id", F.when(F.col("planted"), F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def run_report(collapsed: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of ``doc_id, runs, collapsed``."""
    runs = F.col("runs")
    # Greatest length, then smallest start, then smallest period.
    key = lambda r: F.struct((-r["length"]).alias("shorter"), r["start"], r["period"])
    best = F.array_min(F.transform(runs, key))
    line = lambda r: F.concat_ws(",", *[r[n].cast("string") for n in ("start", "length", "period")])
    lines: Column = F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")
    rows = collapsed.select("doc_id", "runs", "collapsed", best.alias("best"))
    length = -F.col("best.shorter")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op11_periodic_runs")
def periodic_runs(spark, folder):
    return run_report(collapse_runs(with_planted_runs(table(spark, folder, "documents"))))
