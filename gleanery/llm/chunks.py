"""Substring dedup by content-defined chunking with a gear rolling hash.

Every text is cut where the rolling hash has a valley, so equal passages are cut alike wherever they stand and an
insertion moves no cut but those beside it.  Chunks are compared by a digest of 128 bits; neighbouring chunks that
other documents have too are put together to spans, which are then extended, character by character, as far as
another holder has the same text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm import gear
from gleanery.llm import hashing as H
from gleanery.llm.registry import query, table
from gleanery.llm.text import stored, word_count
from gleanery.operators.joins import broadcast_if_small

# Chunks are longer than REACH bytes and about twice as long on average.
REACH = 24
# Words of a reported span, counted between its real ends.
FEWEST_WORDS = 25
_OTHER_VALUES = H.mix(H.BYTE_VALUES + np.uint64(1))


def cut_positions(texts: H.Texts) -> np.ndarray:
    """Sorted ends of the chunks of all texts, never inside a character."""
    ends = [texts.offsets[1:]]
    for a, b in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist()):
        at = gear.valleys(texts.data[a:b], REACH) + a
        for _ in range(3):
            at = at + ((texts.data[np.minimum(at, b - 1)] & 0xC0) == 0x80)
        ends.append(at)
    return np.unique(np.concatenate(ends))


def chunked(documents: DataFrame) -> DataFrame:
    """``doc_id, text, row`` and the array ``chunks`` of ``start, chars, words, high, low`` of every row."""
    rows = documents.select("doc_id", F.col("text").alias("__text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, texts in H.slices(batch.column("__text")):
                end = cut_positions(texts)
                end = end[end > 0]
                start = np.concatenate([[0], end[:-1]])[:len(end)]
                text = np.searchsorted(texts.offsets, start, "right") - 1
                sums = H.prefix_sums(texts.data)
                other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(
                    _OTHER_VALUES[texts.data] * H.powers(len(texts.data) + 1)[0][:len(texts.data)], dtype=np.uint64)])
                chars = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
                begins = np.zeros(len(texts.data) + 1, np.int64)
                begins[H.runs(texts, sums=sums).start + 1] = 1
                words = np.cumsum(begins)
                parts = {
                    "start": (chars[start] - chars[texts.offsets[text]]).astype(np.int32),
                    "chars": (chars[end] - chars[start]).astype(np.int32), "words": (words[end] - words[start]).astype(np.int32),
                    "high": H.span_hashes(sums, start, end).view(np.int64),
                    "low": H.span_hashes(other, start, end).view(np.int64)}
                ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))]).astype(np.int32)
                inner = pa.StructArray.from_arrays([pa.array(v) for v in parts.values()], list(parts))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(first, stop - first),
                    "text": batch.column("__text").slice(first, stop - first),
                    "chunks": pa.ListArray.from_arrays(ends, inner)})

    kind = T._parse_datatype_string("chunks array<struct<start: int, chars: int, words: int, high: long, low: long>>")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType()), *kind.fields])
    return rows.mapInArrow(cut, schema).withColumn("row", F.monotonically_increasing_id())


def _common_start(a: Column, b: Column, bits: int) -> Column:
    """Length of the longest common start of two strings of fewer than ``2 ** bits`` characters."""
    most = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(bits))])
    same = lambda at, step: (at + step <= most) & (F.substr(a, at + 1, step) == F.substr(b, at + 1, step))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(same(at, step), at + step).otherwise(at))


def _extensions(ends: DataFrame, texts: DataFrame) -> DataFrame:
    """``row, island, left, more``: by how many characters an end of a span moves outwards.

    ``ends`` has ``row, island, left, at`` and the same place ``other, other_at`` in another holder.  The texts around
    both are compared in windows, longer ones for the ends that used up the last.
    """
    done, bits = None, 8
    ends = stored(ends.withColumn("more", F.lit(0)), "gear-ends")
    while True:
        size = (1 << bits) - 1
        places = ends.select("row", "left", "at").unionByName(ends.select(F.col("other").alias("row"), "left", F.col("other_at").alias("at")))
        places = stored(places.distinct(), "gear-places")
        before = F.reverse(F.substr("text", F.greatest(F.col("at") - size, F.lit(0)) + 1, F.least("at", F.lit(size))))
        window = F.when(F.col("left"), before).otherwise(F.substr("text", F.col("at") + 1, F.lit(size)))
        windows = texts.select("row", "text").join(broadcast_if_small(places), "row").select("row", "left", "at", window.alias("own"))
        windows = stored(windows, "gear-windows")
        others = windows.select(F.col("row").alias("other"), "left", F.col("at").alias("other_at"), F.col("own").alias("its"))
        both = ends.join(windows, ["row", "left", "at"]).join(others, ["other", "left", "other_at"])
        found = stored(both.withColumn("same", _common_start(F.col("own"), F.col("its"), bits)).drop("own", "its"), "gear-same")
        ready = found.select("row", "island", "left", (F.col("more") + F.col("same")).alias("more"))
        done = ready if done is None else done.unionByName(ready)
        moved = F.when(F.col("left"), -F.col("same")).otherwise(F.col("same"))
        ends = found.where(F.col("same") == size).select(
            "row", "island", "left", (F.col("at") + moved).alias("at"), "other", (F.col("other_at") + moved).alias("other_at"),
            (F.col("more") + F.col("same")).alias("more"))
        if not ends.limit(1).count():
            return done.groupBy("row", "island").agg(
                F.max(F.when(F.col("left"), F.col("more"))).alias("before"), F.max(F.when(~F.col("left"), F.col("more"))).alias("after"))
        bits = min(bits + 3, 20)


def repeated_spans(documents: DataFrame, fewest_words: int = FEWEST_WORDS) -> DataFrame:
    """One row per span that other rows hold too: ``doc_id, start, n_chars, n_words, first_doc_id, n_holders, first``.

    ``start`` and ``n_chars`` count code points; ``first_doc_id`` is the least ``doc_id`` of the rows that hold a chunk
    of the span, ``n_holders`` the most occurrences of a chunk, and ``first`` marks the occurrences to keep.  Spans
    reach as far as the first or the last holder of their outermost chunks has the same text, so those of passages that
    meet may overlap; spans of fewer than ``fewest_words`` words are not reported.
    Null and empty texts have no chunks, repeated rows repeat each other, repeats inside one text alone are not
    reported, an empty table gives no rows.
    """
    texts = stored(chunked(documents), "gear-chunks")
    chunks = texts.select("doc_id", "row", F.posexplode("chunks").alias("n", "chunk")).select("doc_id", "row", "n", "chunk.*")
    place = F.struct("row", "start")
    shared = chunks.groupBy("high", "low").agg(
        F.min(place).alias("one"), F.max(place).alias("last"), F.min("doc_id").alias("first_doc_id"),
        F.count("*").alias("n_holders")).where("one.row < last.row")
    # Stored, so that both sides of the join are plain exchanges, whose hot digests adaptive execution can split.
    found = chunks.join(stored(shared, "gear-shared"), ["high", "low"])
    of_text = Window.partitionBy("row").orderBy("n")  # one text's chunks
    found = found.withColumn("island", F.col("n") - F.row_number().over(of_text))
    outer = F.struct("n", "one", "last", "chars")
    spans = found.groupBy("row", "island").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("chars").cast("int").alias("n_chars"),
        F.min("first_doc_id").alias("first_doc_id"), F.max("n_holders").alias("n_holders"),
        F.min(F.col("one.row") == F.col("row")).alias("first"), F.min(outer).alias("head"), F.max(outer).alias("tail"))
    spans = stored(spans, "gear-spans")
    ends = None
    for left, chunk in ((True, "head"), (False, "tail")):
        holder = F.explode(F.array(f"{chunk}.one", f"{chunk}.last")).alias("holder")
        at, beyond = (F.col("start"), F.lit(0)) if left else (F.col("start") + F.col("n_chars"), F.col(f"{chunk}.chars"))
        side = spans.select("row", "island", F.lit(left).alias("left"), at.alias("at"), beyond.alias("beyond"), holder)
        side = side.where("holder.row <> row").select(
            "row", "island", "left", "at", F.col("holder.row").alias("other"), (F.col("holder.start") + F.col("beyond")).alias("other_at"))
        ends = side if ends is None else ends.unionByName(side)
    reach = stored(_extensions(ends, texts), "gear-reach")
    spans = spans.join(reach, ["row", "island"]).select(
        "row", "doc_id", (F.col("start") - F.col("before")).alias("start"),
        (F.col("n_chars") + F.col("before") + F.col("after")).alias("n_chars"), "first_doc_id", "n_holders", "first")
    # Two islands may have grown to the same span.
    spans = spans.groupBy("row", "start", "n_chars").agg(
        F.first("doc_id").alias("doc_id"), F.min("first_doc_id").alias("first_doc_id"),
        F.max("n_holders").alias("n_holders"), F.min("first").alias("first"))
    # A word takes two characters with the space after it.
    spans = stored(spans.where(F.col("n_chars") >= 2 * fewest_words - 1), "gear-grown")
    words = word_count(F.substr("text", F.col("start") + 1, F.col("n_chars")))
    counted = texts.select("row", "text").join(broadcast_if_small(spans), "row").withColumn("n_words", words)
    return counted.where(F.col("n_words") >= fewest_words).select(
        "doc_id", F.col("start").cast("long").alias("start"), F.col("n_chars").cast("long").alias("n_chars"), "n_words",
        "first_doc_id", "n_holders", "first")


@query("op8_gear_chunks")
def gear_chunks(spark, folder):
    return repeated_spans(table(spark, folder, "documents"))
