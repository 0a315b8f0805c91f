"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus, beside count rules.

Every text is cut into pieces (runs of letters and digits, runs of signs); single pieces and neighbouring pairs hash
into buckets.  Two multinomials over the buckets, of the trusted texts and of all texts, give each bucket a weight; a
document's score is the mean weight of its n-grams, so its length does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm import hashing as H
from gleanery.llm.registry import query, table

BUCKETS = 1 << 12
# Labelled documents that stand for the target: a bounded sample, by the hash of their id.
TRUSTED_DOCUMENTS = 20_000
# Weight of the corpus in the target's multinomial, in n-grams: without evidence the ratio is 1.
PRIOR = 10_000.0
THRESHOLD = -0.2
SYMBOLS = b"#*$%&|<>"
FEWEST_WORDS = 50
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def _ngrams(texts: H.Texts) -> tuple[np.ndarray, np.ndarray]:
    """The text and the bucket of every single piece and every pair."""
    pieces = H.runs(texts, H.PIECE_CLASS)
    together = pieces.text[1:] == pieces.text[:-1]
    pairs = H.mix(pieces.hash[:-1] * np.uint64(3) + pieces.hash[1:])[together]
    hashes = np.concatenate([pieces.hash, pairs])
    return np.concatenate([pieces.text, pieces.text[1:][together]]), (hashes % np.uint64(BUCKETS)).astype(np.int64)


def bucket_counts(documents: DataFrame) -> np.ndarray:
    """``(2, BUCKETS)``: n-grams of all rows, and of the rows with ``trusted``; summed in each task, then per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            trusted = batch.column("trusted").fill_null(False).to_numpy(zero_copy_only=False)
            for first, stop, texts in H.slices(batch.column("text")):
                text, bucket = _ngrams(texts)
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                total[1] += np.bincount(bucket[trusted[first:stop][text]], minlength=BUCKETS)
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_pydict({"bucket": used, "raw": total[0][used], "target": total[1][used]})

    counts = documents.select("text", "trusted").mapInArrow(count, "bucket long, raw long, target long")
    summed = np.zeros((2, BUCKETS), np.int64)
    for row in counts.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():  # BUCKETS rows at most
        summed[:, row[0]] = row[1], row[2]
    return summed


def bucket_weights(counts: np.ndarray) -> np.ndarray:
    """Log ratio of the two multinomials; 0 where nothing is known."""
    raw = (counts[0] + 1.0) / (counts[0].sum() + BUCKETS)
    target = (counts[1] + PRIOR * raw) / (counts[1].sum() + PRIOR)
    return np.log(target / raw)


def _repeats(texts: H.Texts, words: H.Runs) -> np.ndarray:
    """Words of each text in a window of three that the text has more than once."""
    if len(words.text) < 3:
        return np.zeros(len(texts), np.int64)
    whole = words.text[2:] == words.text[:-2]
    a, b, c = words.hash[:-2], words.hash[1:-1], words.hash[2:]
    windows = H.mix(H.mix(a * np.uint64(3) + b) * np.uint64(5) + c + words.text[2:].astype(np.uint64))
    at = np.flatnonzero(whole)
    order = at[np.argsort(windows[at], kind="stable")]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = windows[order[1:]] == windows[order[:-1]]
    again = order[same[1:] | same[:-1]]
    marked = np.zeros(len(words.text), bool)
    for k in range(3):
        marked[again + k] = True
    return np.bincount(words.text[marked], minlength=len(texts))


def _measure(texts: H.Texts, weights: np.ndarray) -> dict[str, np.ndarray]:
    n = len(texts)
    sums = H.prefix_sums(texts.data)
    words = H.runs(texts, sums=sums)
    filled = ~H.IS_SPACE[texts.data]
    lines = H.lines(texts, sums)
    held = np.concatenate([[0], np.cumsum(filled, dtype=np.int64)])
    with_word = held[lines.end] > held[lines.start]
    line = H.mix(lines.hash + lines.text.astype(np.uint64))[with_word]
    line_text = lines.text[with_word]
    _, first = np.unique(line, return_index=True)
    text, bucket = _ngrams(texts)
    ngrams = np.bincount(text, minlength=n)
    return {
        "n_words": np.bincount(words.text, minlength=n),
        "word_chars": H.counts_by_text(texts, filled & ((texts.data & 0xC0) != 0x80)),
        "n_symbols": H.counts_by_text(texts, IS_SYMBOL[texts.data]),
        "n_dup_lines": np.bincount(line_text, minlength=n) - np.bincount(line_text[first], minlength=n),
        "n_repeat_words": _repeats(texts, words),
        "log_ratio": np.bincount(text, weights[bucket], minlength=n) / np.maximum(ngrams, 1),
    }


def quality_rules(
    documents: DataFrame, trusted: DataFrame, *, threshold: float = THRESHOLD, sample: int = TRUSTED_DOCUMENTS,
) -> DataFrame:
    """``doc_id`` of every row with its counts, ``log_ratio``, ``base_failed`` and ``kept``.

    ``trusted`` holds the ``doc_id`` of the target documents, of which ``sample`` are used.  A null text has no words
    and fails; repeated rows are judged one by one; without any trusted document every ratio is 0; other columns are
    ignored; an empty table gives an empty one.
    """
    rows = documents.select("doc_id", "text")
    named = trusted.select(F.col("doc_id").alias("_id")).where("_id IS NOT NULL").distinct()
    named = named.orderBy(F.xxhash64("_id"), "_id").limit(sample).withColumn("trusted", F.lit(True))
    marked = rows.join(F.broadcast(named), F.col("doc_id") == F.col("_id"), "left")  # at most ``sample`` ids
    weights = bucket_weights(bucket_counts(marked))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, texts in H.slices(batch.column("text")):
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column("doc_id").slice(first, stop - first)} | _measure(texts, weights))

    kind = rows.schema["doc_id"].dataType
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(n, T.LongType()) for n in longs],
                           T.StructField("log_ratio", T.DoubleType())])
    measured = rows.mapInArrow(measure, schema)
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = measured.withColumn("base_failed", failed)
    return measured.withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold))


@query("op1_quality_ratio")
def quality_ratio(spark, folder):
    trusted = table(spark, folder, "labels").where("quality = 1")
    return quality_rules(table(spark, folder, "documents"), trusted)
