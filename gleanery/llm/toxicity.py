"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of the embeddings of its own hash and of the hashes of its first bytes.  Filters of several
widths run over the vectors, the maximum of each filter over the text goes into a logistic output.  Trained on all labelled
documents but a fifth: in every epoch each task learns from its own documents, then the tasks' parameters are averaged.
Scores are calibrated, and the threshold of each language chosen, on the fifth that training leaves out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm import hashing as H
from gleanery.llm.registry import query, table
from gleanery.llm.text import stored
from gleanery.operators.joins import broadcast_if_small

BUCKETS = 1 << 17
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
# Labelled documents that a task learns from, on average, where there are as many.
TASK_DOCUMENTS = 2500
# Words a task holds at a time, in documents that are learnt from in random order.
LOT_WORDS = 1 << 20
EPOCHS = 6
# Few documents are gone over more often, until so many steps are made.
FEWEST_STEPS = 60
BATCH = 32
RATE = 0.08
THRESHOLD = 0.7
# A language with fewer calibration rows of either class has the common threshold.
FEWEST_CALIBRATION = 15
PREFIXES = (4, 5)
# A bucket is learnt if so many training documents have it: rarer ones would only be learnt by heart.
FEWEST_DOCUMENTS = 3
_PAD = max(WIDTHS) - 1
# Raw scores are counted in steps of this size.
RAW_STEP = 1 / 256
# Parameters are averaged as whole numbers of this size, so that their order does not matter.
_UNIT = 2.0**-24


class Model(NamedTuple):
    embeddings: np.ndarray
    kernels: tuple[np.ndarray, ...]  # (width, DIM, FILTERS) each
    biases: np.ndarray
    output: np.ndarray
    calibration: tuple[float, float]


def token_ids(texts: H.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all words, some rows of 0 after each text, and the row where each text begins."""
    texts = H.Texts(H.LOWER[texts.data], texts.offsets)
    sums = H.prefix_sums(texts.data)
    words = H.runs(texts, H.PIECE_CLASS, sums)
    hashes = [words.hash]
    for k, length in enumerate(PREFIXES):
        first = H.span_hashes(sums, words.start, np.minimum(words.start + length, words.end))
        hashes.append(H.mix(first + np.uint64(k + 1)))
    starts = np.concatenate([[0], np.cumsum(np.bincount(words.text, minlength=len(texts)) + _PAD)])
    ids = np.zeros((starts[-1], len(hashes)), np.int32)
    at = np.arange(len(words.text)) + _PAD * words.text
    for k, h in enumerate(hashes):
        ids[at, k] = 1 + h % np.uint64(BUCKETS - 1)
    return ids, starts[:-1]


def _responses(vectors: np.ndarray, kernels: tuple[np.ndarray, ...], biases: np.ndarray) -> np.ndarray:
    """(rows, filters of all widths): rows near the end of a text run into its padding."""
    made = []
    for kernel in kernels:
        out = vectors @ kernel[0]
        for k in range(1, len(kernel)):
            out[:-k] += vectors[k:] @ kernel[k]
        made.append(out)
    return np.maximum(np.concatenate(made, 1) + biases, 0)


def logits(model: Model, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0)
    vectors = model.embeddings[ids[:, 0]]
    for k in range(1, ids.shape[1]):
        vectors += model.embeddings[ids[:, k]]
    out = _responses(vectors, model.kernels, model.biases)
    out[ids[:, 0] == 0] = 0  # padding answers nothing: its filters would reach into the next text
    pooled = np.maximum.reduceat(out, starts, axis=0)
    return pooled @ model.output[:-1] + model.output[-1]


def probability(model: Model, raw: np.ndarray) -> np.ndarray:
    slope, shift = model.calibration
    return 1 / (1 + np.exp(-np.clip(slope * raw + shift, -30, 30)))


def _evidence(by_class: list[np.ndarray], clean: int, toxic: int) -> np.ndarray:
    """How surely a bucket belongs to the toxic documents: the z score of its document shares, cut to a small range."""
    shares = by_class[1] / toxic, by_class[0] / clean
    common = (by_class[0] + by_class[1]) / (clean + toxic)
    spread = np.sqrt(np.maximum(common * (1 - common), 1e-12) * (1 / toxic + 1 / clean))
    return np.clip(((shares[0] - shares[1]) / spread - 3) / 4, 0, 2)


class Learner(NamedTuple):
    """Parameters while they are learnt, and the sums of their squared gradients."""

    embeddings: np.ndarray
    squares: np.ndarray  # by bucket
    dense: list[np.ndarray]  # kernels, biases, output
    dense_squares: list[np.ndarray]

    def model(self) -> Model:
        return Model(self.embeddings, tuple(self.dense[:-2]), self.dense[-2], self.dense[-1], (1.0, 0.0))


def _start(by_class: np.ndarray, clean: int, toxic: int, rng: np.random.Generator) -> tuple[Learner, np.ndarray]:
    """What learning begins with, from the number of documents of each class with a bucket; and buckets that are not learnt."""
    fixed = by_class[0] + by_class[1] < FEWEST_DOCUMENTS
    fixed[0] = True
    embeddings = np.zeros((BUCKETS, DIM), np.float32)
    embeddings[:, 0] = np.where(fixed, 0, _evidence(by_class, clean, toxic))
    kernels = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    biases = np.full(len(WIDTHS) * FILTERS, 0.05, np.float32)
    output = np.concatenate([rng.normal(0, 0.2, len(biases)), [0]]).astype(np.float32)
    for w, kernel in enumerate(kernels):  # the first filter of each width starts as a reader of the evidence
        kernel[:, :, 0] = np.eye(DIM)[0]
        output[w * FILTERS] = 1
    dense = [*kernels, biases, output]
    return Learner(embeddings, np.full(BUCKETS, 1e-6, np.float32), dense, [np.full_like(x, 1e-6) for x in dense]), fixed


def _learn(learner: Learner, fixed: np.ndarray, pieces: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray,
           rng: np.random.Generator) -> list[np.ndarray]:
    """One pass of Adagrad on the log loss, in place; only the rows that win a maximum get a gradient.  Buckets changed."""
    embeddings, kernels, biases, output = learner.embeddings, learner.dense[:-2], learner.dense[-2], learner.dense[-1]
    changed = []
    order = rng.permutation(len(pieces))
    for first in range(0, len(order), BATCH):
        chosen = order[first:first + BATCH]
        ids = np.concatenate([pieces[i] for i in chosen])
        starts = np.concatenate([[0], np.cumsum([len(pieces[i]) for i in chosen])])
        vectors = embeddings[ids].sum(1)
        out = _responses(vectors, tuple(kernels), biases)
        out[ids[:, 0] == 0] = 0
        best = np.stack([out[a:b].argmax(0) + a for a, b in zip(starts, starts[1:])])
        pooled = np.take_along_axis(out, best, 0)
        raw = pooled @ output[:-1] + output[-1]
        error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - toxic[chosen]
        error = (error * weight[chosen]).astype(np.float32) / len(chosen)
        to_pool = error[:, None] * output[:-1] * (pooled > 0)
        step = np.concatenate([pooled.T @ error, [error.sum()]])
        rows, changes = [], []
        for w, kernel in enumerate(kernels):
            part = slice(w * FILTERS, (w + 1) * FILTERS)
            grad = to_pool[:, part]
            change = np.zeros_like(kernel)
            for k in range(len(kernel)):
                at = np.minimum(best[:, part] + k, len(vectors) - 1)
                change[k] = np.einsum("bfd,bf->df", vectors[at], grad)
                rows.append(ids[at].reshape(-1, ids.shape[1]))
                changes.append((grad[:, :, None] * kernel[k].T).reshape(-1, DIM))
            learner.dense_squares[w] += change**2
            kernel -= RATE * change / np.sqrt(learner.dense_squares[w])
        gradients = to_pool.sum(0), step
        for value, square, change in zip(learner.dense[-2:], learner.dense_squares[-2:], gradients):
            square += change**2
            value -= RATE * change / np.sqrt(square)
        buckets = np.concatenate(rows)
        used, place = np.unique(buckets, return_inverse=True)
        total = np.zeros((len(used), DIM), np.float32)
        for column in place.reshape(buckets.shape).T:
            np.add.at(total, column, np.concatenate(changes))
        total[fixed[used]] = 0
        learner.squares[used] += (total**2).mean(1)
        embeddings[used] -= RATE * total / np.sqrt(learner.squares[used])[:, None]
        changed.append(used[~fixed[used]])
    return changed


def _passes(documents: int) -> int:
    """How often documents are gone over in all."""
    return max(EPOCHS, -(-FEWEST_STEPS * BATCH // documents))


def train(texts: list[str], toxic: np.ndarray, seed: int = 0) -> Model:
    """A model of a few texts, without Spark."""
    rng = np.random.default_rng(seed)
    pieces = []
    for text in texts:
        data = text.encode()
        pieces.append(token_ids(H.Texts(np.frombuffer(data, np.uint8), np.array([0, len(data)])))[0])
    by_class = np.stack([np.bincount(np.concatenate([np.unique(p) for p, y in zip(pieces, toxic) if y == c]), minlength=BUCKETS)
                         for c in (0, 1)])
    learner, fixed = _start(by_class, (toxic == 0).sum(), (toxic == 1).sum(), rng)
    for _ in range(_passes(len(texts))):
        _learn(learner, fixed, pieces, toxic, np.ones(len(texts)), rng)
    return learner.model()


def _document_counts(rows: DataFrame) -> np.ndarray:
    """For each class and bucket, how many documents have it."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for first, stop, texts in H.slices(batch.column("text")):
                ids, starts = token_ids(texts)
                text = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(ids))))
                own = np.unique(text[:, None] * BUCKETS + ids)
                np.add.at(found, (toxic[first:stop].astype(np.int64)[own // BUCKETS], own % BUCKETS), 1)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"at": at.astype(np.int64), "n": found.ravel()[at]})

    counts = rows.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # 2 * BUCKETS rows at most
    made = np.zeros(2 * BUCKETS, np.int64)
    made[counts["at"].to_numpy()] = counts["n"].to_numpy()
    return made.reshape(2, BUCKETS)


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Word numbers and classes of documents, of about LOT_WORDS words together."""
    pieces, classes, size = [], [], 0
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for first, stop, texts in H.slices(batch.column("text")):
            ids, starts = token_ids(texts)
            pieces.extend(np.split(ids, starts[1:]))
            classes.append(toxic[first:stop])
            size += len(ids)
            if size >= LOT_WORDS:
                yield pieces, np.concatenate(classes)
                pieces, classes, size = [], [], 0
    if pieces:
        yield pieces, np.concatenate(classes)


def _epoch(rows: DataFrame, learner: Learner, fixed: np.ndarray, weights: tuple[float, float], epoch: int) -> Learner:
    """Every task goes over its documents, beginning with the same parameters; their averages are the next ones.

    A task counts by its documents.  A bucket's parameters are averaged over the tasks that changed them.
    """
    shipped = rows.sparkSession.sparkContext.broadcast((tuple(learner), fixed))
    shapes = [x.shape for x in (*learner.dense, *learner.dense_squares)]
    numbers = sum(int(np.prod(shape)) for shape in shapes)
    width = DIM + 1
    columns = [f"v{k}" for k in range(width)]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, still = shipped.value
        own = Learner(parts[0].copy(), parts[1].copy(), [x.copy() for x in parts[2]], [x.copy() for x in parts[3]])
        rng = np.random.default_rng(epoch)
        documents, changed = 0, []
        for pieces, toxic in _lots(batches):
            again = -(-_passes(len(pieces)) // EPOCHS) if not documents else 1
            documents += len(pieces)
            for _ in range(again):
                changed.extend(_learn(own, still, pieces, toxic, np.where(toxic == 1, weights[1], weights[0]), rng))
            changed = [np.unique(np.concatenate(changed))]
        if not documents:
            return
        dense = np.zeros(-(-numbers // width) * width)
        dense[:numbers] = np.concatenate([x.ravel() for x in (*own.dense, *own.dense_squares)])
        values = np.concatenate([np.column_stack([own.embeddings[changed[0]], own.squares[changed[0]]]), dense.reshape(-1, width)])
        slots = np.concatenate([changed[0], BUCKETS + np.arange(len(dense) // width)])
        whole = np.rint(values / _UNIT).astype(np.int64) * documents
        yield pa.RecordBatch.from_pydict(
            {"slot": slots.astype(np.int64), "n": np.full(len(slots), documents)} | dict(zip(columns, whole.T.copy())))

    learnt = rows.mapInArrow(learn, "slot long, n long, " + ", ".join(f"{c} long" for c in columns))
    sums = learnt.groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns)).toArrow()  # BUCKETS rows or so
    slots, n = sums["slot"].to_numpy(), sums["n"].to_numpy()
    values = (np.column_stack([sums[c].to_numpy() for c in columns]) / n[:, None] * _UNIT).astype(np.float32)
    bucket = slots < BUCKETS
    embeddings, squares = learner.embeddings.copy(), learner.squares.copy()
    embeddings[slots[bucket]], squares[slots[bucket]] = values[bucket, :DIM], np.maximum(values[bucket, DIM], 1e-6)
    flat = values[~bucket][np.argsort(slots[~bucket])].ravel()[:numbers]
    made = [part.reshape(shape) for part, shape in zip(np.split(flat, np.cumsum([int(np.prod(x)) for x in shapes])[:-1]), shapes)]
    half = len(learner.dense)
    shipped.unpersist()
    return Learner(embeddings, squares, made[:half], [np.maximum(x, 1e-6) for x in made[half:]])


def _calibrate(raw: np.ndarray, toxic: np.ndarray, times: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit to softened labels (Platt), by a few Newton steps; scores occur some ``times``."""
    positive, negative = times[toxic == 1].sum(), times[toxic == 0].sum()
    if positive + negative < 10 or not positive or not negative:
        return 1.0, 0.0
    soft = np.where(toxic == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    weight, ridge = times / times.sum(), 1e-3 / times.sum()
    x = np.stack([raw, np.ones_like(raw)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        beta += np.linalg.solve(hessian, x.T @ (weight * (soft - p)) - ridge * (beta - [1, 0]))
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


def _thresholds(score: np.ndarray, toxic: np.ndarray, lang: np.ndarray, times: np.ndarray | None = None) -> dict[str, float]:
    """For each language the middle of the gap, nearest to the common threshold, with the fewest errors."""
    chosen = {}
    times = np.ones(len(score), np.int64) if times is None else times
    by_score = np.argsort(score, kind="stable")
    score, toxic, lang, times = score[by_score], toxic[by_score], lang[by_score], times[by_score]
    for name in sorted({x for x in lang if isinstance(x, str)}):
        own = lang == name
        of_class = [np.concatenate([[0], np.cumsum(times[own] * (toxic[own] == c))]) for c in (0, 1)]  # below each score
        if min(below[-1] for below in of_class) < FEWEST_CALIBRATION:
            continue
        levels = np.unique(np.concatenate([score[own], [0.0, 1.0]]))
        middles = np.concatenate([(levels[1:] + levels[:-1]) / 2, [THRESHOLD]])
        at = np.searchsorted(score[own], middles, "left")
        errors = of_class[1][at] + of_class[0][-1] - of_class[0][at]
        best = np.flatnonzero(errors == errors.min())
        chosen[name] = float(middles[best[np.abs(middles[best] - THRESHOLD).argmin()]])
    return chosen


def fit(documents: DataFrame, labels: DataFrame) -> tuple[Model | None, dict[str, float]]:
    """Train on all labelled documents but a fifth, chosen by the hash of the id.

    On that fifth scores are calibrated and the languages' thresholds chosen.  Every row of ``documents`` with a label
    counts.  Without documents of both classes there is no model.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic")).where("_toxic IN (0, 1) AND _id IS NOT NULL")
    known = known.groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    rows = documents.join(broadcast_if_small(known), F.col("doc_id") == F.col("_id")).select(
        "text", "lang", F.col("_toxic").cast("long").alias("toxic"), (F.pmod(F.xxhash64("_id"), F.lit(5)) == 4).alias("aside"))
    rows = stored(rows, "toxicity-labelled")
    counts = {(row[0], row[1]): row[2] for row in rows.groupBy("aside", "toxic").count().collect()}  # four rows
    clean, toxic = counts.get((False, 0), 0), counts.get((False, 1), 0)
    if not clean or not toxic:
        return None, {}
    # Without a shuffle: a task that had but a few documents would learn them by heart.
    training = rows.where("NOT aside").select("text", "toxic").coalesce(max(1, (clean + toxic) // TASK_DOCUMENTS))
    learner, fixed = _start(_document_counts(training), clean, toxic, np.random.default_rng(0))
    weights = (clean + toxic) / (2 * clean), (clean + toxic) / (2 * toxic)  # both classes count alike
    for epoch in range(EPOCHS):
        learner = _epoch(training, learner, fixed, weights, epoch)
    model = learner.model()
    raw = scored(rows.where("aside"), model, ("lang", "toxic"), "raw", calibrated=False)
    # Steps of the raw scores, of which there are some thousands: all rows are in their counts.
    step = F.round(F.greatest(F.lit(-64.0), F.least(F.lit(64.0), "raw")) / RAW_STEP).cast("long")
    steps = stored(raw.groupBy("lang", "toxic", step.alias("step")).agg(F.count("*").alias("n")), "toxicity-steps")
    found = steps.groupBy("toxic", "step").agg(F.sum("n").alias("n")).orderBy("step", "toxic").toPandas()
    model = model._replace(calibration=_calibrate(
        found["step"].to_numpy() * RAW_STEP, found["toxic"].to_numpy(dtype=float), found["n"].to_numpy(dtype=float)))
    often = steps.groupBy("lang").agg(F.sum(F.col("n") * F.col("toxic")).alias("_toxic"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("_clean"))
    often = often.where(F.least("_toxic", "_clean") >= FEWEST_CALIBRATION).select("lang")
    found = steps.join(F.broadcast(often), "lang").toPandas()
    score = probability(model, found["step"].to_numpy(dtype=float) * RAW_STEP)
    return model, _thresholds(score, found["toxic"].to_numpy(dtype=float), found["lang"].to_numpy(), found["n"].to_numpy(dtype=np.int64))


def scored(documents: DataFrame, model: Model | None, keep: tuple[str, ...], name: str = "score",
           calibrated: bool = True) -> DataFrame:
    """The columns ``keep`` of every row and its score, from its whole text alone."""
    rows = documents.select(*dict.fromkeys((*keep, "text")))
    shipped = rows.sparkSession.sparkContext.broadcast(model and tuple(model))  # a fixed size: BUCKETS * DIM numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shipped.value and Model(*shipped.value)
        for batch in batches:
            for first, stop, texts in H.slices(batch.column("text")):
                made = logits(net, *token_ids(texts)) if net else np.zeros(stop - first)
                if net and calibrated:
                    made = probability(net, made)
                kept = {k: batch.column(k).slice(first, stop - first) for k in keep}
                yield pa.RecordBatch.from_pydict(kept | {name: pa.array(made, pa.float64())})

    fields = [rows.schema[k] for k in keep]
    return rows.mapInArrow(score, T.StructType([*fields, T.StructField(name, T.DoubleType())]))


def threshold_of(lang: Column, thresholds: dict[str, float]) -> Column:
    chosen = F.lit(THRESHOLD)
    for name, value in thresholds.items():
        chosen = F.when(lang == name, F.lit(value)).otherwise(chosen)
    return chosen


def classify(documents: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row's ``keep`` columns, ``score``, and ``rejected``: whether it reaches its language's threshold.

    Null and empty texts are scored like a text without words; a null or rare language has the common threshold;
    repeated rows get equal scores; without labels of both classes every score is 0; an empty table gives an empty one.
    """
    model, thresholds = fit(documents, labels)
    rows = scored(documents.withColumn("__lang", F.col("lang")), model, (*keep, "__lang"))
    return rows.withColumn("rejected", F.col("score") >= threshold_of(F.col("__lang"), thresholds)).drop("__lang")


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` without the rows their language's threshold rejects, all columns as they were."""
    model, thresholds = fit(documents, labels)
    rows = scored(documents, model, tuple(documents.columns), "__score")
    return rows.where(F.col("__score") < threshold_of(F.col("lang"), thresholds)).drop("__score")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query("op6_toxicity_cnn")
def toxicity_cnn(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    labels = table(spark, folder, "labels").where(~held_out(F.col("doc_id")))
    rows = classify(documents, labels)
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "rejected")
