"""Language-model scoring by a weighted backoff automaton.

Counts come from all training documents; pairs and triples of words seen FEWEST times are kept, whatever their words.  The
states are the empty context, single words and pairs of words that have kept n-grams; an arc carries the log-probability
of a word, and a failure arc leads, at the cost of the backoff weight, to the state of the shorter context.  One
left-to-right traversal carries the state of every text and adds up.  The automaton holds the most frequent words and
n-grams.  As a backed-off probability is a sum over the words and n-grams of a text, each with what it adds to the shorter
ones and to its use as a context, all others are added by a join with their table: nothing is left out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleanery.llm import blocks
from gleanery.llm import hashing as H
from gleanery.llm.registry import query, table
from gleanery.llm.text import drop, shuffles_go, stored

# Words and n-grams of either length that the automaton holds; they bound what is sent to the tasks, about 40 MB.
AUTOMATON_WORDS = 1 << 19
KEPT_NGRAMS = 1 << 19
# N-grams are made of so many of the most frequent words; of all words if None.
HEAD_WORDS = None
FEWEST = 3
# Bits of a set's sieve, 8 MB: what passes may be in the set, what does not pass is not.
SIEVE = 1 << 26
DISCOUNT = 0.75
# Texts are traversed in pieces side by side; a piece begins with the words before it, which give its first state.
PIECE = 128
TRAVERSED = 1 << 20  # bytes of texts that are side by side
WARM = 2
END = np.uint64(0x5EED5EED5EED5EED)  # stands for the hash of the end token
GATHERED = 1 << 21
# n-grams and their places are dealt by parts of their ids, one for about so many training tokens, in blocks of bytes.
PART_TOKENS = 1 << 22
FEWEST_PARTS = 16
# Documents are scored in so many rounds: of the places, only those of one round are on disk at a time.
ROUNDS = 4
_FIRST_BITS = 19  # of a word's hash, by which it is looked for in the head
_HASHED = np.uint64(1 << 63)  # ids below 0 are hashes
_WORD, _PAIR = (1 << 20) - 1, (1 << 40) - 1


class Head(NamedTuple):
    """The words that have numbers."""

    hash: np.ndarray  # sorted
    rank: np.ndarray  # their numbers, by falling count
    first: np.ndarray  # by the first bits of a hash: where such hashes begin


class Automaton(NamedTuple):
    unigram: np.ndarray  # by number: log10 of the empty context's probability
    context: np.ndarray  # by number: the state after this word
    arcs: np.ndarray  # state << 20 | word, sorted
    weight: np.ndarray
    target: np.ndarray
    backoff: np.ndarray  # by state
    failure: np.ndarray


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def token_hashes(texts: H.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, an end after each, and the position where each text begins."""
    words = H.runs(H.Texts(H.LOWER[texts.data], texts.offsets))
    counts = np.bincount(words.text, minlength=len(texts)) + 1
    starts = np.concatenate([[0], np.cumsum(counts)])
    hashes = np.full(starts[-1], END)
    hashes[np.arange(len(words.text)) + words.text] = words.hash
    return hashes, starts


def _summed(column: str, gathered: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Counts of the values of each batch; the engine adds those of all batches."""
    for values in gathered:
        found, times = np.unique(values, return_counts=True)
        yield pa.RecordBatch.from_pydict({column: found.view(np.int64), "n": times})


def _in_lots(arrays: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    held, size = [], 0
    for a in arrays:
        held.append(a)
        size += len(a)
        if size >= GATHERED:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def word_counts(texts: DataFrame) -> DataFrame:
    """``word`` (64-bit hash) and ``n`` of every token of the ``text`` column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = (token_hashes(t)[0] for b in batches for _, _, t in H.slices(b.column("text")))
        yield from _summed("word", _in_lots(hashes))

    return texts.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _step() -> Column:
    return F.floor(F.log2("n") * 16)


def _lowest_step(counts: DataFrame, bound: int) -> int | None:
    """All rows with counts of this step or a higher one are ``bound`` at most; steps are 16th powers of 2."""
    steps = counts.groupBy(_step().alias("step")).count().collect()  # a thousand rows at most
    total, lowest = 0, None
    for row in sorted(steps, reverse=True):
        if total + row[1] > bound:
            break
        total, lowest = total + row[1], row[0]
    return lowest


def _from(step: int | None) -> Column:
    return F.lit(False) if step is None else _step() >= step


def _arrays(counts: DataFrame) -> list[np.ndarray]:
    """The columns of a bounded table, in the order of the first."""
    columns = [c.to_numpy() for c in counts.toArrow().columns]
    order = np.argsort(columns[0])
    return [c[order] for c in columns]


def head_of(hashes: np.ndarray, times: np.ndarray) -> Head:
    """The words, which are sorted, and their numbers by falling count."""
    rank = np.empty(len(hashes), np.int64)
    rank[np.lexsort((hashes, -times))] = np.arange(len(hashes))
    begin = np.arange(1 << _FIRST_BITS, dtype=np.uint64) << np.uint64(64 - _FIRST_BITS)
    return Head(hashes, rank, np.searchsorted(hashes, begin).astype(np.int32))


def number_words(head: Head, hashes: np.ndarray) -> np.ndarray:
    """Numbers of the words, -1 for those not in the head.

    Hashes are spread evenly, so a word is at most a few places behind the first with the same first bits.
    """
    if not len(head.hash):
        return np.full(len(hashes), -1, np.int64)
    last = len(head.hash) - 1
    at = np.minimum(head.first[hashes >> np.uint64(64 - _FIRST_BITS)], last)
    found = head.hash[at]
    ahead = np.flatnonzero((found < hashes) & (at < last))
    while len(ahead):
        at[ahead] += 1
        found[ahead] = head.hash[at[ahead]]
        ahead = ahead[(found[ahead] < hashes[ahead]) & (at[ahead] < last)]
    return np.where(found == hashes, head.rank[at], -1)


def word_ids(head: Head, hashes: np.ndarray) -> np.ndarray:
    """Numbers of the words of the head, hashes with the highest bit set for the others."""
    number = number_words(head, hashes)
    return np.where(number >= 0, number, (hashes | _HASHED).view(np.int64))


def longer(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Ids of n-grams: 1, then 20 bits for each word's number, or a hash where a word has no number."""
    hashed = (H.mix(H.mix(context.view(np.uint64)) + word.view(np.uint64)) | _HASHED).view(np.int64)
    pair = (1 << 40) | (context << 20) | word
    triple = (1 << 60) | ((context & ((1 << 40) - 1)) << 20) | word
    return np.where((context >= 0) & (word >= 0), np.where(context < 1 << 40, pair, triple), hashed)


def sieve(rows: DataFrame) -> np.ndarray:
    """The sieve of the ``id`` column: SIEVE / 64 rows at most are collected."""
    place = f"((id ^ shiftrightunsigned(id, 17) ^ shiftrightunsigned(id, 37)) & {SIEVE - 1}L)"
    bits = rows.select(F.expr(place).alias("place")).groupBy(F.expr("shiftright(place, 6)").alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(place & 63 AS INT)))").alias("bits"))
    with shuffles_go(rows.sparkSession):
        bits = bits.toArrow()
    made = np.zeros(SIEVE >> 6, np.int64)
    made[bits["at"].to_numpy()] = bits["bits"].to_numpy()
    return made.view(np.uint64)


def passes(made: np.ndarray, ids: np.ndarray) -> np.ndarray:
    x = ids.view(np.uint64)
    place = (x ^ (x >> np.uint64(17)) ^ (x >> np.uint64(37))) & np.uint64(SIEVE - 1)
    return (made[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _follows(starts: np.ndarray, n: int, behind: int) -> np.ndarray:
    """Whether a token has so many others before it in its text."""
    return np.arange(n) - np.repeat(starts[:-1], np.diff(starts)) >= behind


def _pair_ids(ids: np.ndarray) -> np.ndarray:
    """Of every token with the one before it, also across texts."""
    return np.concatenate([ids[:1], longer(ids[:-1], ids[1:])])


def parted(ids: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the ids by part, otherwise as they were, and where each part begins in it."""
    x = ids.view(np.uint64)
    part = ((x ^ (x >> np.uint64(20)) ^ (x >> np.uint64(40))) & np.uint64(0x7FFFFFFF)) % np.uint64(parts)
    part = part.astype(np.uint16 if parts <= 1 << 16 else np.int64)
    return np.argsort(part, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])


def part_of(parts: int) -> Column:
    """The part of the ``id`` column, as in ``parted``."""
    return F.expr(f"CAST(((id ^ shiftrightunsigned(id, 20) ^ shiftrightunsigned(id, 40)) & 2147483647L) % {parts} AS INT)")


def _sums(keys: tuple[np.ndarray, ...], times: np.ndarray | None = None) -> list[np.ndarray]:
    """Sorted distinct keys, of one or two columns, and the sums of their ``times``."""
    if not len(keys[0]):
        return [*keys, np.zeros(0, np.int64)]
    if len(keys) == 1 and times is None:
        return [*np.unique(keys[0], return_counts=True)]
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    differs = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    new = np.concatenate([[0], 1 + np.flatnonzero(differs)])
    times = np.ones(len(order), np.int64) if times is None else times[order]
    return [*(k[new] for k in keys), np.add.reduceat(times, new)]


def ngram_counts(texts: DataFrame, head: Broadcast, allowed: Broadcast, parts: int, of_pairs: bool = False) -> DataFrame:
    """``context, word, id, n`` of the pairs that occur FEWEST times, or of the triples, if ``allowed`` is of pairs.

    A triple is counted if both its pairs pass their sieve, a pair if both words pass theirs.  Counts of a task's lots go
    to the parts as blocks: ids of numbered words alone, as these tell context and word, of other n-grams both.
    """
    columns = ("ids", "times", "contexts", "words", "often")

    def grams(texts: H.Texts) -> np.ndarray:
        hashes, starts = token_hashes(texts)
        ids = word_ids(Head(*head.value), hashes)
        if not of_pairs:
            fine = passes(allowed.value, ids) & ((HEAD_WORDS is None) | (ids >= 0))
            at = np.flatnonzero(_follows(starts, len(ids), 1))
            at = at[fine[at] & fine[at - 1]]
            return np.stack([ids[at - 1], ids[at]])
        pair = _pair_ids(ids)
        fine = passes(allowed.value, pair)
        at = np.flatnonzero(_follows(starts, len(ids), 2))
        at = at[fine[at] & fine[at - 1]]
        return np.stack([pair[at - 1], ids[at]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _in_lots((grams(t).T for b in batches for _, _, t in H.slices(b.column("text")))):
            ids = longer(lot[:, 0], lot[:, 1])
            numbered, times = _sums((ids[ids >= 0],))
            context, word, often = _sums((lot[ids < 0, 0], lot[ids < 0, 1]))
            order, begin = parted(numbered, parts)
            numbered, times = numbered[order], times[order]
            order, begin2 = parted(longer(context, word), parts)
            context, word, often = context[order], word[order], often[order]
            made = []
            for k in range(parts):
                own, own2 = slice(begin[k], begin[k + 1]), slice(begin2[k], begin2[k + 1])
                made.append((blocks.pack_sorted(numbered[own]), blocks.pack(times[own] - 1), blocks.pack_sorted(context[own2]),
                             blocks.pack(word[own2]), blocks.pack(often[own2] - 1)))
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(parts), pa.int32())} | {
                name: pa.array(column, pa.binary()) for name, column in zip(columns, zip(*made))})

    def add(table: pa.Table) -> pa.Table:
        ids, times, contexts, words, often = (
            [blocks.unpack_sorted(b) if name in ("ids", "contexts") else blocks.unpack(b) for b in table.column(name).to_pylist()]
            for name in columns)
        id_, n = _sums((np.concatenate(ids),), np.concatenate(times) + 1)
        context, word, n2 = _sums((np.concatenate(contexts), np.concatenate(words)), np.concatenate(often) + 1)
        id_, n = id_[n >= FEWEST], n[n >= FEWEST]
        context, word, n2 = context[n2 >= FEWEST], word[n2 >= FEWEST], n2[n2 >= FEWEST]
        before = np.where(id_ < 1 << 60, (id_ >> 20) & _WORD, (1 << 40) | ((id_ >> 20) & _PAIR))
        return pa.table({
            "context": np.concatenate([before, context]), "word": np.concatenate([id_ & _WORD, word]),
            "n": np.concatenate([n, n2]), "id": np.concatenate([id_, longer(context, word)])})

    counted = texts.select("text").mapInArrow(count, "part int, " + ", ".join(f"{name} binary" for name in columns))
    return counted.groupBy("part").applyInArrow(add, "context long, word long, n long, id long")


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return np.where(keys[at] == wanted, at, -1) if len(keys) else np.full(len(wanted), -1)


def build(words: list, pairs: list, triples: list) -> Automaton:
    """States, arcs and failure arcs.

    ``words`` and ``pairs`` are ids, probabilities and backoff weights, NaN for what is no context; ``triples`` ids and
    probabilities; all sorted.  The pairs of every triple and the words of every pair are among them.
    """
    mask = (1 << 20) - 1
    is_state, is_state2 = ~np.isnan(words[2]), ~np.isnan(pairs[2])
    context = np.where(is_state, np.cumsum(is_state), 0)
    offset = 1 + int(is_state.sum())
    first, second = (pairs[0] >> 20) & mask, pairs[0] & mask
    after_pair = np.where(is_state2, offset + np.cumsum(is_state2) - 1, context[second])
    prefix, last = (triples[0] >> 20) & ((1 << 40) - 1) | (1 << 40), triples[0] & mask
    state2 = after_pair[_find(pairs[0], prefix)]
    after_triple = after_pair[_find(pairs[0], (1 << 40) | ((prefix & mask) << 20) | last)]
    # The first arc belongs to no state: there may be no other.
    arcs = np.concatenate([[-1], (context[first] << 20) | second, (state2 << 20) | last]).astype(np.int64)
    order = np.argsort(arcs)
    weight = np.concatenate([[0.0], np.log10(pairs[1]), np.log10(triples[1])])[order]
    target = np.concatenate([[0], after_pair, after_triple]).astype(np.int64)[order]
    backoff = np.log10(np.concatenate([[1.0], words[2][is_state], pairs[2][is_state2]]))
    failure = np.concatenate([np.zeros(offset, np.int64), context[second[is_state2]]])
    return Automaton(np.log10(words[1]), context, arcs[order], weight, target, backoff, failure)


def _backoff(rows: DataFrame, probability: str, below: str) -> DataFrame:
    """``at, backoff`` of every context: its freed mass over what the shorter context gives to all other words."""
    free = (1 - F.sum(probability)) / F.greatest(1 - F.sum(below), F.lit(1e-12))
    return rows.groupBy(F.col("context").alias("at")).agg(F.greatest(free, F.lit(1e-12)).alias("backoff"))


class Fitted(NamedTuple):
    head: Broadcast
    automaton: Automaton
    others: DataFrame  # __part, id, value, base: blocks of the words and n-grams outside the automaton; n-grams have no base
    sieve: np.ndarray  # of the n-grams among them
    tokens: int
    types: int
    parts: int


def packed(rows: DataFrame, parts: int) -> DataFrame:
    """``id, value, base`` as one block a part, sorted by id, so that every round moves few rows."""

    def pack(table: pa.Table) -> pa.Table:
        part, id_, value, base = (table.column(name).to_numpy() for name in ("__part", "id", "value", "base"))
        order = np.argsort(id_.view(np.uint64))
        word = np.flatnonzero(~np.isnan(base[order]))
        made = {"id": blocks.pack_sorted(id_[order]), "value": value[order].tobytes(), "word": blocks.pack_sorted(word),
                "base": base[order][word].tobytes()}
        return pa.table({"__part": part[:1]} | {name: pa.array([block], pa.binary()) for name, block in made.items()})

    of_part = rows.select(part_of(parts).alias("__part"), "id", "value", "base").groupBy("__part")
    return of_part.applyInArrow(pack, "__part int, id binary, value binary, word binary, base binary")


def fit(texts: DataFrame) -> Fitted:
    """Absolute discounting, the freed mass going to the shorter context."""
    context = texts.sparkSession.sparkContext
    counts = stored(word_counts(texts), "lm-counts")
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head_step = _lowest_step(counts, HEAD_WORDS or AUTOMATON_WORDS)
    found, times = _arrays(counts.where(_from(head_step)))  # as many rows at most
    order = np.argsort(found.view(np.uint64))
    head = context.broadcast(tuple(head_of(found.view(np.uint64)[order], times[order])))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = word_ids(Head(*head.value), batch.column("word").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column("n")], ["id", "n"])

    words = counts.mapInArrow(numbered, "id long, n long")
    words = stored(words.withColumn("p", (F.col("n") + 1) / F.lit(float(tokens + types + 1))), "lm-words")
    drop(counts)
    allowed = context.broadcast(sieve(words.where(F.col("n") >= FEWEST)))
    parts = max(FEWEST_PARTS, tokens // PART_TOKENS)
    counted = stored(ngram_counts(texts, head, allowed, parts), "lm-pairs")
    allowed = context.broadcast(sieve(counted))
    counted3 = stored(ngram_counts(texts, head, allowed, parts, of_pairs=True), "lm-triples")

    of_context = words.select(F.col("id").alias("context"), F.col("n").alias("times"))
    of_word = words.select(F.col("id").alias("word"), F.col("p").alias("below"))
    pairs = counted.join(of_context, "context").join(of_word, "word")
    pairs = stored(pairs.withColumn("p", (F.col("n") - DISCOUNT) / F.col("times")).drop("times"), "lm-pairs-of-words")
    drop(counted)
    backoff = stored(_backoff(pairs, "p", "below"), "lm-backoff")
    of_context = pairs.select(F.col("id").alias("context"), F.col("n").alias("times"), F.col("word").alias("middle"))
    of_word = pairs.select(F.col("context").alias("middle"), "word", F.col("p").alias("below"))
    triples = counted3.join(of_context, "context").join(of_word, ["middle", "word"])
    triples = triples.withColumn("p", (F.col("n") - DISCOUNT) / F.col("times")).drop("times", "middle", "word")
    triples = stored(triples, "lm-triples-of-pairs")
    drop(counted3)
    backoff2 = stored(_backoff(triples, "p", "below"), "lm-backoff-of-pairs")

    def with_backoff(rows: DataFrame, of: DataFrame) -> DataFrame:
        return rows.join(of, rows["id"] == of["at"], "left").drop("at")

    def value() -> Column:
        """What an n-gram adds to the shorter one, and what its use as a context costs."""
        return F.log10("p") - F.log10("below") - F.log10("before") + F.log10(F.coalesce(F.col("backoff"), F.lit(1.0)))

    before, before2 = (b.select(F.col("at").alias("context"), F.col("backoff").alias("before")) for b in (backoff, backoff2))
    made = words, pairs, triples, backoff, backoff2
    words = stored(with_backoff(words, backoff), "lm-words-valued")
    pairs = with_backoff(pairs.join(before, "context"), backoff2)
    pairs = stored(pairs.select("id", "n", "p", "backoff", value().alias("value")), "lm-pairs-valued")
    triples = triples.join(before2, "context").withColumn("backoff", F.lit(None).cast("double"))
    triples = stored(triples.select("id", "n", "p", value().alias("value")), "lm-triples-valued")
    drop(*made)

    # One step for both lengths: an n-gram is no more frequent than its parts, so these are in the automaton with it.
    steps = [head_step, _lowest_step(pairs, KEPT_NGRAMS), _lowest_step(triples, KEPT_NGRAMS) if triples.count() else 0]
    inside = _from(None if None in steps else max(steps))
    automaton = build(
        _arrays(words.where("id >= 0").select("id", "p", F.coalesce(F.col("backoff"), F.lit(float("nan"))))),
        _arrays(pairs.where(inside).select("id", "p", F.coalesce(F.col("backoff"), F.lit(float("nan"))))),
        _arrays(triples.where(inside).select("id", "p")))  # bounded by AUTOMATON_WORDS and KEPT_NGRAMS
    base = F.log10("p")
    rare = words.where("id < 0").select(
        "id", (base + F.log10(F.coalesce(F.col("backoff"), F.lit(1.0)))).alias("value"), base.alias("base"))
    grams = pairs.where(~inside).select("id", "value").unionByName(triples.where(~inside).select("id", "value"))
    others = rare.unionByName(grams.select("id", "value", F.lit(None).cast("double").alias("base")))
    others, made = stored(packed(others, parts), "lm-others"), sieve(grams)
    drop(words, pairs, triples)
    return Fitted(head, automaton, others, made, tokens, types, parts)


def traverse(automaton: Automaton, word: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Log10 probability of each text; words of number -1 cost their backoff weights only, the rest comes by a join."""
    a = automaton
    n_texts = len(starts) - 1
    pieces = -(-np.diff(starts) // PIECE)
    text = np.repeat(np.arange(n_texts), pieces)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = starts[text] + nth * PIECE
    length = np.minimum(starts[text + 1] - begin, PIECE)
    order = np.argsort(-length, kind="stable")
    begin, length, inside = begin[order], length[order], nth[order] > 0
    state = np.zeros(len(begin), np.int64)
    score = np.zeros(len(begin))
    active_at = np.searchsorted(-length, -np.arange(PIECE), "left")  # pieces longer than t
    for t in range(-WARM, PIECE):
        at = np.flatnonzero(inside) if t < 0 else np.arange(active_at[t])
        if not len(at):
            continue
        w, s = word[begin[at] + t], state[at]
        cost = np.zeros(len(at))
        arrived = np.zeros(len(at), np.int64)
        open_ = np.arange(len(at))
        while len(open_):
            at_root = s[open_] == 0
            root, open_ = open_[at_root], open_[~at_root]
            known = root[w[root] >= 0]
            cost[known] += a.unigram[w[known]]
            arrived[known] = a.context[w[known]]
            if not len(open_):
                break
            key = (s[open_] << 20) | np.maximum(w[open_], 0)
            arc = np.minimum(np.searchsorted(a.arcs, key), len(a.arcs) - 1)
            hit = (a.arcs[arc] == key) & (w[open_] >= 0)
            there = open_[hit]
            cost[there] += a.weight[arc[hit]]
            arrived[there] = a.target[arc[hit]]
            open_ = open_[~hit]
            cost[open_] += a.backoff[s[open_]]
            s[open_] = a.failure[s[open_]]
        state[at] = arrived
        if t >= 0:
            score[at] += cost
    return np.bincount(text[order], score, n_texts)


def score_documents(documents: DataFrame, training: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row's ``keep`` columns, ``n_tokens, n_known, train_tokens, base_score, score``.

    ``base_score`` is the empty context alone.  A null text is empty: its end is its only token.  Repeated rows are
    scored one by one, other columns are ignored, an empty table gives an empty one; without training texts every
    token is unknown.
    """
    fitted = fit(training)
    unknown = float(np.log10(fitted.tokens + fitted.types + 1))
    parts = fitted.parts
    rows = documents.select(*keep, F.col("text").alias("__text"))
    head = fitted.head
    shipped = rows.sparkSession.sparkContext.broadcast((tuple(fitted.automaton), fitted.sieve))

    def places(first_row: int, lot: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """Rows and ids to be looked up, by part; a row counts from the first of the lot."""
        row, ids = (np.concatenate(x) for x in zip(*lot))
        order = np.argsort(ids.view(np.uint64))
        row, ids = row[order], ids[order]
        order, begin = parted(ids, parts)
        row, ids = row[order], ids[order]
        pieces = [slice(a, b) for a, b in zip(begin, begin[1:])]
        return filled({
            "__row": np.full(parts, first_row, np.int64), "__part": pa.array(range(parts), pa.int32()),
            "rows": pa.array([blocks.pack(row[x]) for x in pieces], pa.binary()),
            "ids": pa.array([blocks.pack_sorted(ids[x]) for x in pieces], pa.binary())})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, others = shipped.value
        a = Automaton(*automaton)
        at = first_row = TaskContext.get().partitionId() << 33
        lot, size = [], 0
        for batch in batches:
            for first, stop, texts in H.slices(batch.column("__text"), TRAVERSED):
                hashes, starts = token_hashes(texts)
                ids = word_ids(Head(*head.value), hashes)
                text = np.repeat(np.arange(len(texts)), np.diff(starts))
                known = ids >= 0
                base = np.zeros(len(ids))
                base[known] = a.unigram[ids[known]]
                pair = _pair_ids(ids)
                triple = np.concatenate([ids[:1], longer(pair[:-1], ids[1:])])
                joined = [(~known, ids), (_follows(starts, len(ids), 1) & passes(others, pair), pair),
                          (_follows(starts, len(ids), 2) & passes(others, triple), triple)]
                for where, of in joined:
                    lot.append((text[where] + (at - first_row), of[where]))
                    size += len(lot[-1][0])
                kept = {name: batch.column(name).slice(first, stop - first) for name in keep}
                yield filled(kept | {
                    "__row": np.arange(at, at + len(texts)), "__part": np.arange(at, at + len(texts)) % parts, "n_tokens": np.diff(starts),
                    "n_known": np.bincount(text, known, len(texts)).astype(np.int64),
                    "base_score": np.bincount(text, base, len(texts)), "score": traverse(a, np.where(known, ids, -1), starts)})
                at += len(texts)
                if size >= GATHERED:
                    yield places(first_row, lot)
                    first_row, lot, size = at, [], 0
        if size:
            yield places(first_row, lot)

    fields = [T.StructField(f.name, f.dataType) for f in rows.drop("__text").schema.fields]
    more = "__row long, n_tokens long, n_known long, base_score double, score double, "
    schema = T.StructType([*fields, *T._parse_datatype_string(more + "__part int, rows binary, ids binary").fields])
    summed = T.StructType([*fields, *T._parse_datatype_string(more + "__value double, __base double, __found long").fields])
    arrow, arrow_summed = to_arrow_schema(schema), to_arrow_schema(summed)

    def filled(columns: dict, schema: pa.Schema = arrow) -> pa.RecordBatch:
        """All columns, those not given null."""
        size = len(columns["__row"])
        return pa.RecordBatch.from_arrays(
            [pa.nulls(size, f.type) if f.name not in columns else pa.array(columns[f.name], f.type) for f in schema], schema.names)

    def look_up(places: pa.Table, others: pa.Table) -> pa.Table:
        """What the places of a part add to each row; rows of documents pass."""
        ids, value, base = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        if len(others):  # one row
            block = {name: others.column(name)[0].as_py() for name in ("id", "value", "word", "base")}
            ids, value = blocks.unpack_sorted(block["id"]), np.frombuffer(block["value"])
            base = np.full(len(ids), np.nan)
            base[blocks.unpack_sorted(block["word"])] = np.frombuffer(block["base"])
        documents = places.filter(pc.is_null(places.column("ids")))
        made = [filled(dict(zip(documents.column_names, (c.combine_chunks() for c in documents.columns))), arrow_summed)]
        blocks_ = places.filter(pc.is_valid(places.column("ids")))
        for k in range(len(blocks_)):
            first_row, row, wanted = (blocks_.column(name)[k].as_py() for name in ("__row", "rows", "ids"))
            row, found = blocks.unpack(row), _find(ids.view(np.uint64), blocks.unpack_sorted(wanted).view(np.uint64))
            row, found = row[found >= 0], found[found >= 0]
            word = ~np.isnan(base[found])
            times, values, bases, words = (np.bincount(row, x) for x in (None, value[found], np.where(word, base[found], 0), word))
            own = np.flatnonzero(times)
            made.append(filled({"__row": own + first_row, "__value": values[own], "__base": bases[own],
                                "__found": words[own].astype(np.int64)}, arrow_summed))
        return pa.Table.from_batches(made)

    # A row's number is that of its task and its place there, so it is the same if a task is run again.  Documents have
    # parts as well: they go through the shuffle of the places, so that these need not be stored.
    own = [f.name for f in summed.fields if f.name not in ("__row", "__value", "__base", "__found")]

    def scored(rows: DataFrame) -> DataFrame:
        found = rows.mapInArrow(score, schema).groupBy("__part").cogroup(fitted.others.groupBy("__part")).applyInArrow(look_up, summed)
        return found.groupBy("__row").agg(
            *(F.first(name, ignorenulls=True).alias(name) for name in own), *(F.sum(c).alias(c) for c in ("__value", "__base", "__found")))

    turn = F.pmod(F.xxhash64(*rows.columns), F.lit(ROUNDS))  # copies of a text are spread by what is kept
    found = functools.reduce(DataFrame.unionByName, (stored(scored(rows.where(turn == k)), "lm-scored") for k in range(ROUNDS)))
    value, base, known = (F.coalesce(F.col(c), F.lit(0)) for c in ("__value", "__base", "__found"))
    # A word that training never had costs the same anywhere.
    never = (F.col("n_tokens") - F.col("n_known") - known) * unknown
    return found.select(
        *keep, "n_tokens", (F.col("n_known") + known).alias("n_known"),
        F.lit(fitted.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + base - never).alias("base_score"),
        (F.col("score") + value - never).alias("score"))


@query("op7_backoff_automaton")
def backoff_automaton(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    rows = score_documents(documents, documents.where(~held_out(F.col("doc_id"))))
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
