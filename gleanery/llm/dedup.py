"""Near-duplicates by DartMinHash: weighted signatures, banded candidates, exact verification, classes.

The elements of a text are its shingles of five words, weighted by how often they occur.  Every element owns a region
of weight by rank, in which darts fall as a Poisson process given by hashes alone; a dart counts for a text if it lies
below the element's weight.  Each dart has a coordinate, and the signature keeps the dart of least rank per coordinate,
so two signatures agree in a coordinate with the probability of the generalised Jaccard similarity.  The cost follows
the number of elements and of darts, not their product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm import hashing as H
from gleanery.llm.registry import query, table
from gleanery.llm.text import stored
from gleanery.operators.joins import broadcast_if_small

SHINGLE_WORDS = 5
SIMILARITY = 0.8
# Pairs at the threshold share at least one of BANDS keys of BAND_ROWS coordinates with probability 0.9999.
BANDS = 18
BAND_ROWS = 4
COORDINATES = BANDS * BAND_ROWS
# Rounds of leaders before the texts that are still apart are compared one by one.
ROUNDS = 8
# Shingles of a tile in which they are, about: of texts outside the largest class of a key, and of any; and of one step.
TILE_OUTSIDE = 1 << 20
TILE_TEXTS = 1 << 21
TILE_STEP = 1 << 20


def _chain(parts: list[np.ndarray], seed: int) -> np.ndarray:
    made = np.full(len(parts[0]), seed, np.uint64)
    for part in parts:
        made = H.mix(made * np.uint64(3) + part)
    return made


def shingles(texts: H.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and hash of every shingle, ordered by both, and 16 bytes for each text's sequence of words.

    A text of fewer words than a shingle has one shingle of them all; a text without words has none.
    """
    words = H.runs(texts)
    n, size = len(texts), SHINGLE_WORDS
    counts = np.bincount(words.text, minlength=n)
    starts = np.cumsum(counts) - counts
    # A polynomial of the word hashes, as of the bytes of a word.
    base = H.powers(len(words.text) + 1)[0]
    place = np.arange(len(words.text)) - starts[words.text]
    digest = np.zeros((n, 2), np.uint64)
    for k in range(2):
        terms = H.mix(words.hash + np.uint64(k + 11)) * base[place]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        digest[:, k] = H.mix(sums[starts + counts] - sums[starts] + counts.astype(np.uint64))
    short = np.flatnonzero((counts > 0) & (counts < size))
    text, hashes = short, digest[short, 0]
    if len(words.text) >= size:
        whole = words.text[size - 1:] == words.text[:len(words.text) - size + 1]
        long = _chain([words.hash[k:len(words.text) - size + 1 + k][whole] for k in range(size)], 7)
        text, hashes = np.concatenate([text, words.text[size - 1:][whole]]), np.concatenate([hashes, long])
    order = np.lexsort((hashes, text))
    return text[order], hashes[order], digest


def _uniform(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def dart_signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, coordinates: int) -> np.ndarray:
    """``(n, coordinates)`` hashes of the earliest darts; texts without elements have zeros.

    ``text``, ``element`` and positive ``weight`` describe the elements of all texts.
    """
    signature = np.zeros((n, coordinates), np.uint64)
    total = np.bincount(text, weight, n)
    wanted = np.full(n, coordinates * (np.log(coordinates) + 3.0))
    missing = total > 0
    while missing.any():
        rank_limit = np.where(missing, wanted / np.maximum(total, 1e-300), 0.0)
        # Weight is cut at 1, 3, 7, …: level v is as wide as 2 ** v and gets as many darts per unit of rank.
        levels = np.floor(np.log2(weight)).astype(np.int64) + 1
        levels = np.where((2.0 ** np.maximum(levels, 0) - 1 < weight), levels, levels - 1)
        own = missing[text]
        repeat = np.repeat(np.flatnonzero(own), np.maximum(levels[own], 0) + 1)
        level = np.arange(len(repeat)) - np.repeat(
            np.cumsum(np.maximum(levels[own], 0) + 1) - np.maximum(levels[own], 0) - 1, np.maximum(levels[own], 0) + 1)
        inside = 2.0 ** level - 1 < weight[repeat]
        repeat, level = repeat[inside], level[inside].astype(np.uint64)
        width = 2.0 ** level.astype(np.float64)
        cell = H.mix(element[repeat] + level * np.uint64(0xD6E8FEB86659FD93))
        rank = np.zeros(len(repeat))
        limit = rank_limit[text[repeat]]
        keys, ranks, darts = [], [], []
        step = 0
        while len(repeat):
            step += 1
            dart = H.mix(cell + np.uint64(step * int(H._BASE) & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(_uniform(dart)) / width
            near = rank < limit
            repeat, width, cell, rank, limit, dart = repeat[near], width[near], cell[near], rank[near], limit[near], dart[near]
            drawn = H.mix(dart + np.uint64(1))
            hit = (width - 1) + _uniform(drawn) * width < weight[repeat]
            at = (H.mix(drawn + np.uint64(2))[hit] % np.uint64(coordinates)).astype(np.int64)
            keys.append(text[repeat[hit]] * coordinates + at)
            ranks.append(rank[hit])
            darts.append(dart[hit])
        key, rank, dart = np.concatenate(keys), np.concatenate(ranks), np.concatenate(darts)
        best = np.full(n * coordinates, np.inf)
        np.minimum.at(best, key, rank)
        first = rank == best[key]
        signature.reshape(-1)[key[first]] = dart[first]
        empty = np.isinf(best).reshape(n, coordinates).any(1) & missing
        missing, wanted = empty, wanted * 2
    return signature


SIGNATURE_SCHEMA = "digest binary, bands array<long>, shingles array<int>"


def signatures(documents: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` of every row, the ``digest`` of its words, its band keys, and 32 bits for each shingle."""
    rows = documents.select(*keep, F.col("text").alias("__text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, texts in H.slices(batch.column("__text")):
                n = len(texts)
                text, hashes, digest = shingles(texts)
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
                at = np.flatnonzero(new)
                weight = np.diff(np.append(at, len(text)))
                signature = dart_signatures(text[at], hashes[at], weight.astype(float), n, COORDINATES)
                bands = np.stack([_chain([signature[:, b * BAND_ROWS + k] for k in range(BAND_ROWS)], 100 + b)
                                  for b in range(BANDS)], 1)
                filled = np.bincount(text, minlength=n) > 0
                ends = np.concatenate([[0], np.cumsum(filled * BANDS)])
                # The k-th occurrence of a shingle is an element of its own: sets of them have the weighted similarity.
                nth = np.arange(len(text)) - np.repeat(at, weight)
                narrow = (H.mix(hashes + nth.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                sizes = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))])
                kept = {name: batch.column(name).slice(first, stop - first) for name in keep}
                yield pa.RecordBatch.from_pydict(kept | {
                    "digest": pa.array([d.tobytes() for d in digest], pa.binary()),
                    "bands": pa.ListArray.from_arrays(ends.astype(np.int32), bands[filled].reshape(-1).view(np.int64)),
                    "shingles": pa.ListArray.from_arrays(sizes.astype(np.int32), narrow)})

    schema = T.StructType([*rows.drop("__text").schema.fields, *T._parse_datatype_string(SIGNATURE_SCHEMA).fields])
    return rows.mapInArrow(sign, schema)


def classes_of(links: DataFrame) -> DataFrame:
    """Connected components of ``(a, b)``: ``node, root``, the root being the least node.

    Labels fall along links and then to the label of their label, until none changes; a node with very many links only
    makes one side of a join longer, which adaptive execution splits.
    """
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("least"))
        lower = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("root").alias("was"), F.least("root", "least").alias("root"))
        up = labels.select(F.col("node").alias("up"), F.col("root").alias("beyond"))
        moved = stored(lower.join(up, F.col("root") == F.col("up"), "left").select(
            "node", "was", F.least("root", F.coalesce("beyond", "root")).alias("root")), "labels")
        labels = moved.select("node", "root")
        if not moved.where("root < was").limit(1).count():
            return labels


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after more links, of which only classes, not their nodes, are gone through again."""
    for end in ("a", "b"):
        was = roots.select(F.col("node").alias(end), F.col("root").alias(f"of_{end}"))
        links = links.join(was, end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    joined = links.where("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    joined = stored(classes_of(joined).select(F.col("node").alias("was"), F.col("root").alias("now")), "dart-merged")
    # A text without an earlier link was a class of its own.
    alone = joined.join(roots, joined["was"] == roots["node"], "left_anti").select("was", "was")
    all_roots = roots.select("node", "root").unionByName(alone.toDF("node", "root"))
    return all_roots.join(broadcast_if_small(joined), F.col("root") == F.col("was"), "left").select(
        "node", F.coalesce("now", "root").alias("root"))


def _verified(pairs: DataFrame, elements: DataFrame, similarity: float) -> DataFrame:
    """The ``(a, b)`` whose weighted similarity reaches the threshold, compared by all their shingles."""
    named = elements.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    with_a = named.join(broadcast_if_small(pairs), "a")
    other = elements.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    both = with_a.join(other, "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    alike = shared / (F.size("of_a") + F.size("of_b") - shared)
    return both.where(alike >= similarity).select("a", "b")


def _link_tile(similarity: float):
    """Links between the outside texts and the others of one tile of a key, by all their shingles."""
    def link(outside: pa.Table, others: pa.Table) -> pa.Table:
        links = []
        if len(outside) and len(others):
            key = outside.column("key")[0].as_py()
            node, root = others.column("node").to_numpy(), others.column("root").to_numpy()
            bands, sizes, shingles = _facts(others)
            ends = np.cumsum(sizes)
            own_bands, own_sizes, own_shingles = _facts(outside)
            own_ends = np.cumsum(own_sizes)
            nodes, roots, mains = (outside.column(c).to_numpy() for c in ("node", "root", "main"))
            for i in range(len(outside)):
                # In the first key that both share only; two outside texts meet once.
                same = bands == own_bands[i]
                first = same.argmax(1)
                fit = (own_bands[i][first] == key) & (root != roots[i]) & ((root == mains[i]) | (nodes[i] < node))
                fit &= np.minimum(sizes, own_sizes[i]) >= np.maximum(sizes, own_sizes[i]) * similarity
                at = np.flatnonzero(fit)
                if not len(at):
                    continue
                own = np.sort(own_shingles[own_ends[i] - own_sizes[i]:own_ends[i]])
                shared = np.concatenate([
                    _shared(own, shingles, (ends - sizes)[part], sizes[part])
                    for part in np.split(at, np.flatnonzero(np.diff(np.cumsum(sizes[at]) // TILE_STEP)) + 1)])
                alike = shared / (sizes[at] + own_sizes[i] - shared) >= similarity
                # One link joins the two classes.
                _, once = np.unique(root[at[alike]], return_index=True)
                links += [(min(nodes[i], n), max(nodes[i], n)) for n in node[at[alike]][once].tolist()]
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return link


def _shared(own: np.ndarray, shingles: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many of the ``sizes`` shingles from each of ``starts`` on are among the sorted ``own``."""
    offsets = np.cumsum(sizes) - sizes
    theirs = shingles[np.repeat(starts - offsets, sizes) + np.arange(sizes.sum())]
    hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
    return np.add.reduceat(hit.astype(np.int64), offsets)


def _facts(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band keys of every row, how many shingles it has, and all shingles."""
    bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
    lists = rows.column("shingles").combine_chunks()
    return bands, lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()


def _across(everyone: DataFrame, roots: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` between texts of one key but of two classes.

    Per key, the texts outside its largest class are compared with those of all other classes, in tiles of bounded size;
    a pair is compared in the first key that both texts share only, and only links leave a tile, one for two classes.
    """
    # A key of two texts has been compared whole by its first leader.
    placed = everyone.where("n > 2").join(roots.select("node", "root"), "node", "left").select(
        "key", "node", F.coalesce("root", "node").alias("root"))
    placed = stored(placed, "dart-placed")
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    open_keys = parts.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("parts"))
    open_keys = stored(open_keys.where("parts > 1").drop("parts"), "dart-open")
    placed = placed.join(broadcast_if_small(open_keys), "key")
    wanted = stored(placed.select("node").distinct(), "dart-wanted")
    facts = stored(nodes.select("node", "bands", "shingles").join(broadcast_if_small(wanted), "node"), "dart-facts")
    placed = stored(placed.join(facts, "node"), "dart-placed")
    tiles = lambda which, most: F.ceil((F.sum(F.when(which, F.size("shingles"))) + 1) / most).cast("int")
    counts = stored(placed.groupBy("key").agg(
        tiles(F.col("root") != F.col("main"), TILE_OUTSIDE).alias("rows"), tiles(F.lit(True), TILE_TEXTS).alias("columns")), "dart-tiles")
    placed = placed.join(broadcast_if_small(counts), "key")
    # Every tile of a key has some of its outside texts and some of all its texts.
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some_of = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    outside = placed.where("root <> main").withColumns({"row": some_of("rows", 1)}).withColumn("column", all_of("columns"))
    # Columns of their own: Spark cannot tell apart two sides of one table.
    others = placed.select(*[F.col(c).alias(c) for c in placed.columns])
    others = others.withColumns({"column": some_of("columns", 2)}).withColumn("row", all_of("rows"))
    at = ["key", "row", "column"]
    return outside.groupBy(*at).cogroup(others.groupBy(*at)).applyInArrow(_link_tile(similarity), "a long, b long").distinct()


def near_duplicates(documents: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), similarity: float = SIMILARITY) -> DataFrame:
    """One row per row: the columns ``keep`` and ``row, class_id, kept``.

    Classes are the connected parts of all links of weighted similarity ``similarity`` or more; ``class_id`` is the
    least ``doc_id`` of a class, and the row that has it is ``kept``.  Copies are reduced to one node first.  Then each
    band key elects the text with the most neighbours as its leader, to which the key's other texts are compared; texts
    unlike every leader so far elect the next, up to ROUNDS, so a key of m texts costs m comparisons in each round.
    What the leaders left apart is compared across classes (``_across``), so of any two texts that share a key either
    both are in one class or they have been compared.
    Null texts and texts without words are copies of one another; a null ``doc_id`` comes last in its class; repeated
    rows are copies; an empty table gives an empty one.
    """
    signed = signatures(documents, keep).withColumn("row", F.monotonically_increasing_id())
    signed = stored(signed, "dart-signatures")
    # Tables of one row per key are stored before they are joined: both sides of the join are then plain exchanges, of
    # which adaptive execution splits the hot keys.
    groups = stored(signed.groupBy("digest").agg(F.min("row").alias("node")), "dart-groups")
    rows = signed.select(*keep, "row", "digest").join(groups, "digest").select(*keep, "row", "node")
    rows = stored(rows, "dart-rows")
    nodes = signed.join(rows.select("node").where("row = node"), F.col("row") == F.col("node"))
    members = stored(nodes.select("node", F.explode("bands").alias("key")), "dart-members")
    sizes = stored(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "dart-sizes")
    members = stored(members.join(sizes, "key"), "dart-members")
    dense = members.groupBy("node").agg(F.sum("n").alias("dense"))
    members = members.join(dense, "node").select("key", "node", "n", "dense", F.lit(False).alias("covered"))
    members = everyone = stored(members, "dart-members")
    involved = dense.select("node")
    elements = signed.select(F.col("row").alias("node"), "shingles").join(broadcast_if_small(involved), "node", "left_semi")
    elements = stored(elements, "dart-elements")

    links = tested = None
    for _ in range(ROUNDS):
        order = F.struct("dense", F.xxhash64("node"), "node")
        leaders = members.where(~F.col("covered")).groupBy("key").agg(F.max(order)["node"].alias("leader"))
        active = stored(members.join(stored(leaders, "dart-leaders"), "key"), "dart-active")  # keys whose texts are all covered are done
        pairs = active.where(F.col("node") != F.col("leader")).select(
            F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
        pairs = stored(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "dart-pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = stored(_verified(pairs, elements, similarity), "dart-links")
        links = found if links is None else links.unionByName(found)
        near = links.select(F.col("a").alias("node"), F.col("b").alias("leader")).unionByName(
            links.select(F.col("b").alias("node"), F.col("a").alias("leader"))).withColumn("near", F.lit(True))
        covered = F.col("covered") | (F.col("node") == F.col("leader")) | F.col("near").isNotNull()
        members = stored(active.join(broadcast_if_small(near), ["node", "leader"], "left").select(
            "key", "node", "dense", covered.alias("covered")), "dart-members")
        if not members.where(~F.col("covered")).limit(1).count():
            break
    roots = classes_of(links)
    more = stored(_across(everyone, roots, nodes, similarity), "dart-links")
    if more.limit(1).count():
        roots = _merged(roots, more)
    rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("at")))
    rows = stored(rows, "dart-roots")
    heads = stored(rows.groupBy("root").agg(first.alias("first")), "dart-heads")
    return rows.join(heads, "root").select(
        *keep, "row", F.col("first.id").alias("class_id"), (F.col("row") == F.col("first.at")).alias("kept"))


def one_of_each(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``documents`` with one row of each class of near-duplicates, all columns as they were."""
    marked = documents.withColumn("__text_key", F.xxhash64("text"))
    found = stored(near_duplicates(marked, keep=("doc_id", "__text_key"), similarity=similarity), "dart-classes")
    times = found.groupBy(F.col("doc_id"), F.col("__text_key")).agg(F.count("*").alias("times"), F.max("kept").alias("kept"))
    chosen = times.where("kept").select(F.col("doc_id").alias("__id"), F.col("__text_key").alias("__key"), F.col("times").alias("__times"))
    chosen = broadcast_if_small(chosen)
    left = marked.join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key")))
    once = left.where("__times = 1")
    # The same row several times over: only such rows are grouped.
    again = left.where("__times > 1").dropDuplicates(["doc_id", "__text_key"])
    return once.unionByName(again).select(*documents.columns)


@query("op3_dart_minhash")
def dart_minhash(spark, folder):
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "class_id", "kept")
