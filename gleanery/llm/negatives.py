"""Hard negatives by a multiway hyperplane tree whose split points know the distance ranges of their siblings.

Split points come from a bounded sample; every row goes to the nearest split point of a node, down to a leaf, and for
each node the least and greatest distance from every split point to all rows below every sibling are taken over the
whole table.  A search has a window of scores.  With the norms below a subtree a window of inner products is a window of
distances around the anchor, an annulus; the triangle inequality turns the distance to a split point into a window of
distances from that point, and a sibling whose range does not meet it is left out.  Rows of the leaves that remain are
compared exactly, so results are those of comparing everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.registry import query, table
from gleanery.llm.text import stored

POSITIVES = 5
NEGATIVES = 3
# Negatives score between these hundredths of the positive's score.
WINDOW = (50, 95)
SCALE = 256
# The tree is made of so many rows at most, and has so many split points in a node.
SAMPLE_ROWS = 8192
ARITY = 16
LEAF_ROWS = 1024
SAMPLE_PER_LEAF = 8
# Leaves are compared in chunks: the table is cut into CHUNKS, none shorter or longer than these.
CHUNKS = 256
CHUNK_ROWS = (2048, 65_536)
ANCHOR_GROUP = 16_384
# Anchors compared at once, and candidates of an anchor in a leaf beyond which only the best are looked for.
BLOCK = 256
MANY = 32
_KINDS = (("<i2", 2**15 - 1), ("<i4", 2**31 - 1))


def _distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = (rows * rows).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2 * rows @ points.T
    return np.sqrt(np.maximum(squares, 0))


class Tree:
    """Split points, children and, after :meth:`set_ranges`, what lies below every child.  Children below 0 are leaves."""

    def __init__(self, sample: np.ndarray, rows: int, leaf_rows: int = LEAF_ROWS, arity: int = ARITY):
        self.points: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.root = self._grow(sample, rows / max(1, len(sample)), leaf_rows, arity)

    def _grow(self, sample: np.ndarray, share: float, leaf_rows: int, arity: int) -> int:
        wanted = min(arity, math.ceil(len(sample) * share / leaf_rows), len(sample) // SAMPLE_PER_LEAF)
        points = self._far_apart(sample, wanted) if wanted > 1 else sample[:0]
        if len(points) < 2:
            self.leaves += 1
            return -self.leaves
        node = len(self.points)
        self.points.append(points)
        self.children.append([])
        nearest = _distances(sample, points).argmin(1)
        self.children[node] = [self._grow(sample[nearest == j], share, leaf_rows, arity) for j in range(len(points))]
        return node

    @staticmethod
    def _far_apart(sample: np.ndarray, wanted: int) -> np.ndarray:
        """Each the farthest from those before, out of a bounded number of candidates for each point wanted."""
        candidates = sample[:3 * wanted * SAMPLE_PER_LEAF]
        chosen = [0]
        away = _distances(candidates, candidates[:1])[:, 0]
        while len(chosen) < wanted and away.max() > 0:
            chosen.append(int(away.argmax()))
            away = np.minimum(away, _distances(candidates, candidates[chosen[-1:]])[:, 0])
        return candidates[chosen]

    def descend(self, rows: np.ndarray, seen=None) -> np.ndarray:
        """The leaf of every row, from 0; ``seen(node, child, rows, distances)`` is told of all that go to a child."""
        leaf = np.zeros(len(rows), np.int64)
        todo = [(self.root, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                leaf[at] = -node - 1
                continue
            away = _distances(rows[at], self.points[node])
            nearest = away.argmin(1)
            for j, child in enumerate(self.children[node]):
                own = np.flatnonzero(nearest == j)
                if len(own):
                    if seen:
                        seen(node, j, rows[at[own]], away[own])
                    todo.append((child, at[own]))
        return leaf

    def set_ranges(self, found: list) -> None:
        """``found``: rows of ``node, child, least, greatest`` (to each split point), ``low, high`` (squared norms)."""
        m = [len(p) for p in self.points]
        self.least = [np.full((k, k), np.inf) for k in m]
        self.greatest = [np.full((k, k), -np.inf) for k in m]
        self.low, self.high = [np.full(k, np.inf) for k in m], [np.full(k, -np.inf) for k in m]
        for row in found:
            self.least[row["node"]][row["child"]] = row["least"]
            self.greatest[row["node"]][row["child"]] = row["greatest"]
            self.low[row["node"]][row["child"]] = row["low"]
            self.high[row["node"]][row["child"]] = row["high"]

    def search(self, anchors: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchor and leaf wherever the leaf may hold a score from ``lows`` to ``highs``: ``(anchors, windows)`` of bounds."""
        found = []
        norms = (anchors * anchors).sum(1)
        todo = [(self.root, np.arange(len(anchors)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                found.append((at, np.full(len(at), -node - 1)))
                continue
            away = _distances(anchors[at], self.points[node])
            for j, child in enumerate(self.children[node]):
                if not np.isfinite(self.low[node][j]):  # nothing below
                    continue
                least, greatest = self.least[node][j], self.greatest[node][j]
                nearest = np.maximum(np.maximum(away - greatest, least - away).max(1), 0)
                farthest = (away + greatest).min(1)
                # Scores that the annulus from nearest to farthest leaves open, with room for rounding.
                most = (norms[at] + self.high[node][j] - nearest**2) / 2
                fewest = (norms[at] + self.low[node][j] - farthest**2) / 2
                room = 1e-9 * (norms[at] + self.high[node][j] + farthest**2) + 1e-6
                open_ = ((most + room)[:, None] >= lows[at]) & ((fewest - room)[:, None] <= highs[at])
                todo.append((child, at[open_.any(1)]))
        if not found:
            return (np.zeros(0, np.int64),) * 2
        return tuple(np.concatenate(part) for part in zip(*found))


def _decoded(codes: pa.Array | pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    if not len(codes):
        return np.zeros((0, width))
    return np.frombuffer(b"".join(codes.to_pylist()), kind).reshape(len(codes), width).astype(np.float64)


def _encode(kind: str, width: int):
    """Vectors as fixed-width numbers, short ones filled up with zeros."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.zeros((len(batch), width))
            lists = batch.column("vector")
            for size in np.unique(lists.value_lengths().to_numpy()):
                own = np.flatnonzero(lists.value_lengths().to_numpy() == size)
                vectors[own, :size] = lists.take(pa.array(own)).flatten().to_numpy().reshape(len(own), size)
            codes = pa.array([row.tobytes() for row in vectors.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), codes], names=["vec_id", "label", "code"])

    return encode


def _ranges(tree: Tree, kind: str, width: int):
    """Of one task's rows: for each node and child the ranges, and for each leaf (node -1) how many rows."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list] = {}
        counts = np.zeros(tree.leaves, np.int64)

        def see(node, child, rows, away):
            norms = (rows * rows).sum(1)
            new = [away.min(0), away.max(0), norms.min(), norms.max()]
            old = seen.get((node, child), new)
            seen[node, child] = [np.minimum(old[0], new[0]), np.maximum(old[1], new[1]), min(old[2], new[2]), max(old[3], new[3])]

        for batch in batches:
            leaf = tree.descend(_decoded(batch.column("code"), kind, width), see)
            counts += np.bincount(leaf, minlength=tree.leaves)
        rows = [(n, c, i, v[0][i], v[1][i], v[2], v[3], 0) for (n, c), v in seen.items() for i in range(len(v[0]))]
        rows += [(-1, int(leaf), 0, 0.0, 0.0, 0.0, 0.0, int(counts[leaf])) for leaf in np.flatnonzero(counts)]
        names = ("node", "child", "point", "least", "greatest", "low", "high", "n")
        kinds = (pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.int64())
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return measure


def _assign(tree: Tree, kind: str, width: int, chunk_of: np.ndarray, parts: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.descend(_decoded(batch.column("code"), kind, width))
            # Rows of a leaf that fills several chunks are dealt out by their number.
            chunk = chunk_of[leaf] + batch.column("row").to_numpy() % parts[leaf]
            yield pa.RecordBatch.from_pydict({
                "chunk": chunk, "leaf": leaf, "vec_id": batch.column("vec_id"), "label": batch.column("label"),
                "code": batch.column("code")})

    return assign


def _best_of_sample(scores: np.ndarray, open_: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th best open score of each row; minus infinity where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return np.partition(np.where(open_, scores, -np.inf), -k, axis=1)[:, -k]


def _plan_search(tree: Tree, kind: str, width: int, sample: tuple, chunk_of: np.ndarray, parts: np.ndarray, windows: int, k: int):
    """Anchors, one row for each chunk with a leaf that may hold what they look for, with a bound on each window.

    Without ``windows`` an anchor looks for rows of its own label, else for rows of others inside so many windows.  The
    ``k``-th best that the sample holds bounds a search from below.
    """
    positives = not windows
    sample_rows, sample_ids, sample_labels = sample

    def bounds(rows, ids, labels, lows, highs):
        made = np.empty(lows.shape)
        for first in range(0, len(rows), BLOCK):
            part = slice(first, first + BLOCK)
            scores = rows[part] @ sample_rows.T
            same = labels[part, None] == sample_labels[None, :]
            fit = same & (ids[part, None] != sample_ids[None, :]) if positives else ~same
            for w in range(lows.shape[1]):
                inside = fit & (scores >= lows[part, w, None]) & (scores <= highs[part, w, None])
                made[part, w] = np.maximum(lows[part, w], _best_of_sample(scores, inside, k))
        return made

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _decoded(batch.column("code"), kind, width)
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            lows, highs = np.full((len(batch), 1), -np.inf), np.full((len(batch), 1), np.inf)
            if not positives:
                # Places without a window are open nowhere.
                lows, highs = np.full((len(batch), windows), np.inf), np.full((len(batch), windows), -np.inf)
                sizes = batch.column("lows").value_lengths().to_numpy()
                at = np.repeat(np.arange(len(batch)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                lows[at] = batch.column("lows").flatten().to_numpy()
                highs[at] = batch.column("highs").flatten().to_numpy()
            lows = bounds(rows, ids, labels, lows, highs)
            anchor, leaf = tree.search(rows, lows, highs)
            times = parts[leaf]
            chunk = np.repeat(chunk_of[leaf], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            anchor, leaf = np.repeat(anchor, times), np.repeat(leaf, times)
            order = np.lexsort((leaf, chunk, anchor))
            anchor, leaf, chunk = anchor[order], leaf[order], chunk[order]
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (chunk[1:] != chunk[:-1])
            first = np.flatnonzero(new)
            for start in range(0, len(first), 4096):
                own = first[start:start + 4096]
                end = first[start + 4096] if start + 4096 < len(first) else len(leaf)
                picked = batch.take(pa.array(anchor[own]))
                offsets = (np.append(own, end) - own[0]).astype(np.int32)
                even = np.arange(len(own) + 1, dtype=np.int32) * lows.shape[1]
                yield pa.RecordBatch.from_pydict({
                    "chunk": chunk[own], "leaves": pa.ListArray.from_arrays(offsets, leaf[own[0]:end]),
                    "anchor": picked.column("anchor"), "anchor_group": picked.column("anchor_group"),
                    "vec_id": picked.column("vec_id"), "label": picked.column("label"), "code": picked.column("code"),
                    "lows": pa.ListArray.from_arrays(even, lows[anchor[own]].reshape(-1)),
                    "highs": pa.ListArray.from_arrays(even, highs[anchor[own]].reshape(-1))})

    return plan


def _first_of_each(anchor, window, score, ids, k):
    """The ``k`` best of every anchor and window: greatest score first, then least id."""
    order = np.lexsort((ids, -score, window, anchor))
    anchor, window, score, ids = anchor[order], window[order], score[order], ids[order]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1])
    starts = np.flatnonzero(new)
    rank = np.arange(len(anchor)) - np.repeat(starts, np.diff(np.append(starts, len(anchor))))
    kept = rank < k
    return anchor[kept], window[kept], score[kept], ids[kept]


def _candidates(scores: np.ndarray, open_: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of all open scores, of rows with very many only the ``k`` best; columns are ordered by id."""
    many = np.flatnonzero(open_.sum(1) > MANY + k)
    if len(many):
        ranked = np.where(open_[many], scores[many], -np.inf)
        least = np.partition(ranked, -k, axis=1)[:, -k, None]
        ties = open_[many] & (ranked == least)
        # Of those that tie for the last places the first ones stay.
        room = k - (ranked > least).sum(1)
        ties &= np.cumsum(ties, axis=1) <= room[:, None]
        open_ = open_.copy()
        open_[many] = (ranked > least) | ties
    return np.nonzero(open_)


def _compare(kind: str, width: int, positives: bool, k: int):
    """The best ``k`` of a chunk's rows for each anchor and window, by exact scores, leaf by leaf."""
    def compare(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found = []
        if len(rows) and len(anchors):
            rows = rows.sort_by([("leaf", "ascending"), ("vec_id", "ascending")])
            leaf, ids = rows.column("leaf").to_numpy(), rows.column("vec_id").to_numpy()
            labels, vectors = rows.column("label").to_numpy(), _decoded(rows.column("code"), kind, width)
            leaves = anchors.column("leaves").combine_chunks()
            sizes = leaves.value_lengths().to_numpy()
            visits = leaves.flatten().to_numpy()
            visitor = np.repeat(np.arange(len(anchors)), sizes)
            own, own_ids = _decoded(anchors.column("code"), kind, width), anchors.column("vec_id").to_numpy()
            own_labels = anchors.column("label").to_numpy()
            shape = (len(anchors), -1)
            lows = anchors.column("lows").combine_chunks().flatten().to_numpy().reshape(shape)
            highs = anchors.column("highs").combine_chunks().flatten().to_numpy().reshape(shape)
            starts = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1]))
            for start, end in zip(starts, np.append(starts[1:], len(leaf))):
                coming = visitor[visits == leaf[start]]
                for first in range(0, len(coming), BLOCK):
                    some = coming[first:first + BLOCK]
                    scores = own[some] @ vectors[start:end].T
                    same = own_labels[some, None] == labels[None, start:end]
                    fit = same & (own_ids[some, None] != ids[None, start:end]) if positives else ~same
                    for w in range(lows.shape[1]):
                        inside = fit & (scores >= lows[some, w, None]) & (scores <= highs[some, w, None])
                        a, b = _candidates(scores, inside, k)
                        found.append((some[a], np.full(len(a), w), scores[a, b], ids[start:end][b]))
        if found:
            a, w, score, near = _first_of_each(*(np.concatenate(part) for part in zip(*found)), k)
        else:
            a = w = score = near = np.zeros(0, np.int64)
        own = anchors.column("anchor").to_numpy()[a] if len(a) else a
        return pa.table({
            "anchor": pa.array(own, pa.int64()), "place": pa.array(w, pa.int32()),
            "score": pa.array(score, pa.float64()).cast(pa.int64()), "vec_id": pa.array(near, pa.int64())})

    return compare


def _chunks(counts: dict[int, int], leaves: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First chunk and number of chunks of each leaf: neighbours share one, large leaves fill several."""
    wanted = min(max(CHUNK_ROWS[0], rows // CHUNKS), CHUNK_ROWS[1])
    chunk_of, parts = np.zeros(leaves, np.int64), np.ones(leaves, np.int64)
    at, filled = 0, 0
    for leaf in range(leaves):
        n = counts.get(leaf, 0)
        if filled and filled + n > wanted:
            at, filled = at + 1, 0
        chunk_of[leaf], parts[leaf] = at, max(1, math.ceil(n / wanted))
        filled += n
        if parts[leaf] > 1:
            at, filled = at + int(parts[leaf]), 0
    return chunk_of, parts


def hard_negatives(
    vectors: DataFrame, anchor: Column | str, *, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS, arity: int = ARITY,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``(vec_id, label, vector)``.

    Anchors are the rows for which ``anchor`` holds.  Positives are an anchor's ``n_positives`` best rows of its label;
    for each the ``n_negatives`` best rows of other labels that score within ``window`` hundredths of it.  A score is the
    inner product of vectors of whole numbers, exact below 2 ** 53; ties go to the smaller ``vec_id``.  Rows without an
    id, a label, a vector or one of its numbers take no part, shorter vectors end in zeros.  Rows of the anchor's own id
    are not its positives; an anchor's row that is repeated counts once, other repeated rows each; other columns are
    ignored; an empty table gives an empty one.
    """
    usable = "vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL"
    is_anchor = F.expr(anchor) if isinstance(anchor, str) else anchor
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("vector").cast("array<double>").alias("vector"), is_anchor.alias("is_anchor")).where(usable)
    rows = rows.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    spark = vectors.sparkSession
    size, most = F.max(F.size("vector")), F.max(F.coalesce(F.array_max(F.transform("vector", F.abs)), F.lit(0.0)))
    n, width, greatest = rows.agg(F.count("*"), size, most).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], schema)
    width = max(1, width)
    kind = next((k for k, limit in _KINDS if greatest <= limit), "<f8")
    coded = rows.select("vec_id", "label", "vector").mapInArrow(_encode(kind, width), "vec_id long, label long, code binary")
    anchors = rows.where("is_anchor").select("vec_id", "label", "vector").mapInArrow(
        _encode(kind, width), "vec_id long, label long, code binary")
    coded = stored(coded.withColumn("row", F.monotonically_increasing_id()), "gnat-rows")

    # About twice the sample by hash, then the sample: a task sends its share only.
    hashed = F.xxhash64("vec_id", F.lit(11))
    share = min(1.0, 2 * sample_rows / n + 64 / n)
    near = coded.where(F.pmod(hashed, F.lit(1 << 20)) < max(1, round(share * (1 << 20))))
    sample = near.orderBy(hashed, "vec_id", "label", "code").limit(sample_rows).select("vec_id", "label", "code").collect()
    sample_vectors = _decoded(pa.array([r["code"] for r in sample], pa.binary()), kind, width)
    known = (sample_vectors, np.array([r["vec_id"] for r in sample], np.int64), np.array([r["label"] for r in sample], np.int64))
    tree = Tree(sample_vectors, n, leaf_rows, arity)
    measured = coded.select("code").mapInArrow(
        _ranges(tree, kind, width),
        "node int, child int, point int, least double, greatest double, low double, high double, n long")
    measured = measured.groupBy("node", "child", "point").agg(
        F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.min("low").alias("low"),
        F.max("high").alias("high"), F.sum("n").alias("n")).collect()  # split points squared for each node
    ranges: dict[tuple[int, int], dict] = {}
    for row in sorted(measured, key=lambda r: (r["node"], r["child"], r["point"])):
        made = ranges.setdefault((row["node"], row["child"]), {"least": [], "greatest": [], **{
            name: row[name] for name in ("node", "child", "low", "high", "n")}})
        made["least"].append(row["least"])
        made["greatest"].append(row["greatest"])
    tree.set_ranges([r for r in ranges.values() if r["node"] >= 0])
    counts = {leaf: r["n"] for (node, leaf), r in ranges.items() if node < 0}
    chunk_of, parts = _chunks(counts, tree.leaves, n)
    placed = coded.mapInArrow(
        _assign(tree, kind, width, chunk_of, parts), "chunk long, leaf long, vec_id long, label long, code binary")
    placed = stored(placed, "gnat-placed")

    anchors = anchors.distinct().withColumn("anchor", F.monotonically_increasing_id())
    anchors = stored(anchors, "gnat-anchors")
    groups = max(1, math.ceil(anchors.count() / ANCHOR_GROUP))
    anchors = anchors.withColumn("anchor_group", F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int"))
    every_group = placed.withColumn("anchor_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    planned = ("chunk long, leaves array<long>, anchor long, anchor_group int, vec_id long, label long, code binary, "
               "lows array<double>, highs array<double>")

    def best(looking: DataFrame, windows: int, k: int) -> DataFrame:
        plan = _plan_search(tree, kind, width, known, chunk_of, parts, windows, k)
        wanted = looking.mapInArrow(plan, planned)
        keys = ("chunk", "anchor_group")
        found = every_group.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(
            _compare(kind, width, not windows, k), "anchor long, place int, score long, vec_id long")
        order = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = best(anchors, 0, n_positives)
    near = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives"))
    low = lambda p: F.ceil(p["score"].cast("decimal(20,0)") * window[0] / 100).cast("double")
    high = lambda p: F.floor(p["score"].cast("decimal(20,0)") * window[1] / 100).cast("double")
    looking = anchors.join(near, "anchor").withColumns({
        "lows": F.transform("positives", low), "highs": F.transform("positives", high)})
    looking = stored(looking, "gnat-positives")
    hard = best(looking.drop("positives"), n_positives, n_negatives)
    named = looking.select("anchor", F.col("vec_id").alias("anchor_id"), "positives")
    place = F.element_at("positives", F.col("place") + 1)
    return hard.join(named, "anchor").select(
        "anchor_id", place["vec_id"].alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        place["score"].alias("positive_score"), F.col("score").alias("negative_score"))


SQL = f"""
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
            list_inner_product(a.q, b.q)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    positives AS (
        SELECT * FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}),
    negatives AS (
        SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score,
            s.score AS negative_score,
            row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS rank
        FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
            AND {WINDOW[0]} * p.score <= 100 * s.score AND 100 * s.score <= {WINDOW[1]} * p.score)
    SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
    FROM negatives WHERE rank <= {NEGATIVES}"""


@query("op12_gnat_negatives", SQL)
def gnat_negatives(spark, folder):
    rows = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(finite).select("vec_id", label.alias("label"), vector.alias("vector"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)
