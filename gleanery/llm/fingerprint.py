"""Document fingerprints by consistent weighted sampling, DataFrame expressions only.

A text's terms are its words, weighted by how often they occur.  For every term and sample, hashes give two gamma
variates ``r`` and ``c`` and a uniform ``beta``; a term of weight S gets ``t = floor(ln S / r + beta)`` and
``ln a = ln c - r (t - beta + 1)``.  The term of least ``a``, with its ``t``, is the sample.  Two texts agree in a
sample with the probability of their generalised Jaccard similarity.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.registry import query, table
from gleanery.llm.text import SPACE, stored
from gleanery.session import shuffle_width

SAMPLES = 64
# Gamma variates are drawn at so many equally likely levels.
LEVELS = 512
CHUNK_ROWS = 256
COARSE, FINE = 128, 1024
EMPTY = -1


def _gamma_levels() -> list[float]:
    """Quantiles of Gamma(2, 1) in the middle of LEVELS equal shares: where 1 - (1 + x) exp(-x) has that value."""
    made, x = [], 0.0
    for k in range(LEVELS):
        share = (k + 0.5) / LEVELS
        x = max(x, 1e-3)
        for _ in range(60):
            step = (1 - (1 + x) * math.exp(-x) - share) / (x * math.exp(-x))
            x = max(x - step, x / 4)
            if abs(step) < 1e-13:
                break
        made.append(x)
    return made


def _samples(term: Column, log_weight: Column) -> list[Column]:
    """For each sample one long, the less the better: ``ln a`` above, 32 bits of the term and its ``t`` below.

    ``log_weight`` is a column of its own: as an expression it would be evaluated for every sample.
    """
    levels = _gamma_levels()
    # One literal each, shared by all samples; few digits, because every plan's text repeats them.
    gamma, log_gamma = F.lit(np.round(levels, 4)), F.lit(np.round(np.log(levels), 4))
    made = []
    for k in range(SAMPLES):
        bits = F.xxhash64(term, F.lit(k))
        level = lambda shift: F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(LEVELS - 1)).cast("int")  # noqa: E731, B023
        r, log_c = gamma[level(0)], log_gamma[level(12)]
        beta = F.shiftrightunsigned(bits, 24).cast("double") * 2.0**-40
        t = F.floor(log_weight / r + beta)
        log_a = log_c - r * (t - beta + 1.0)
        sample = term.bitwiseXOR(F.shiftleft(t, 7)).bitwiseAND(F.lit(0xFFFFFFFF))
        made.append(F.shiftleft(F.floor((log_a + 64.0) * float(1 << 23)), 32).bitwiseOR(sample))
    return made


def sample_terms(terms: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``samples`` of ``(keys, term, weight)``: ``term`` a long, null where there is none; ``weight`` positive."""
    terms = terms.select(*keys, "term", F.ln("weight").alias("log_weight"))
    least = [F.min(s).alias(f"s{k}") for k, s in enumerate(_samples(F.col("term"), F.col("log_weight")))]
    found = terms.groupBy(*keys).agg(*least)
    values = [F.coalesce(F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(EMPTY)) for k in range(SAMPLES)]
    return found.select(*keys, F.array(*values).alias("samples"))


def term_counts(texts: DataFrame, keys: list[str], sides: list[str]) -> DataFrame:
    """``keys, term`` and ``weights``, how often the term is a word of each of the texts ``sides``.

    A null term stands for a text without words.
    """
    text = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(s).alias("text")) for k, s in enumerate(sides)])).alias("__of")
    words = texts.select(*keys, text).select(*keys, "__of.side", F.explode(F.split("__of.text", f"{SPACE}+")).alias("__word"))
    term = F.when(F.col("__word") != "", F.xxhash64("__word"))
    counts = [F.count(F.when(F.col("side") == k, 1)).alias(f"__{k}") for k in range(len(sides))]
    counted = words.select(*keys, "side", term.alias("term")).groupBy(*keys, "term").agg(*counts)
    return counted.select(*keys, "term", F.array(*[F.col(f"__{k}") for k in range(len(sides))]).alias("weights"))


def sample_pairs(terms: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``samples, edited_samples`` of ``(keys, term, weights)`` of two texts.

    Draws are grouped by the texts they are for, the first (1), the second (2) or both (3), so a term that both texts have
    equally often is drawn for once.
    """
    one, two = F.col("weights")[0], F.col("weights")[1]
    draw = lambda weight, of: F.struct(F.ln(weight).alias("log_weight"), F.lit(of).alias("of"))
    draws = F.when(one == two, F.array(draw(one, 3))).when(two == 0, F.array(draw(one, 1))).when(
        one == 0, F.array(draw(two, 2))).otherwise(F.array(draw(one, 1), draw(two, 2)))
    drawn = terms.select(*keys, "term", F.explode(draws).alias("draw")).select(*keys, "term", "draw.*")
    least = [F.min(s).alias(f"s{k}") for k, s in enumerate(_samples(F.col("term"), F.col("log_weight")))]
    found = drawn.groupBy(*keys, "of").agg(*least)
    found = found.select(*keys, "of", F.array(*[F.col(f"s{k}") for k in range(SAMPLES)]).alias("least"))
    found = found.groupBy(*keys).agg(*[F.max(F.when(F.col("of") == of, F.col("least"))).alias(f"of{of}") for of in (1, 2, 3)])
    none = F.array_repeat(F.lit(None).cast("long"), SAMPLES)
    shared = F.coalesce("of3", none)

    def samples(own: str) -> Column:
        both = F.zip_with(F.coalesce(F.col(own), none), shared, lambda x, y: F.least(x, y))
        return F.transform(both, lambda x: F.coalesce(x.bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(EMPTY).cast("long")))

    return found.select(*keys, samples("of1").alias("samples"), samples("of2").alias("edited_samples"))


def likeness(a: Column, b: Column) -> Column:
    """Share of the samples in which two texts agree: an estimate of their generalised Jaccard similarity."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x) / float(SAMPLES)


def as_text(samples: Column) -> Column:
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def in_chunks(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``chunk``, a number that rises with ``key``: percentiles of the keys, each cut into equal widths.

    Depends on values alone, so a recomputed row has the same chunk.  Null keys come first.
    """
    ends = F.percentile_approx(key, [i / COARSE for i in range(COARSE + 1)], 10_000)
    n, bounds = rows.agg(F.count("*"), ends).first()  # COARSE + 1 numbers
    if not bounds:
        return rows.withColumn("chunk", F.lit(0).cast("long"))
    bounds = sorted({*bounds})
    fine = min(FINE, max(1, n // (CHUNK_ROWS * COARSE) + 1))
    array = F.split(F.lit(",".join(map(str, bounds))), ",").cast(f"array<{rows.schema[key].dataType.simpleString()}>")
    at = F.size(F.filter(array, lambda b: b <= F.col(key)))
    low, high = F.get(array, F.greatest(at - 1, F.lit(0))), F.get(array, F.least(at, F.lit(len(bounds) - 1)))
    width = F.greatest(high.cast("double") - low.cast("double"), F.lit(1.0))
    inner = F.floor((F.col(key).cast("double") - low.cast("double")) / width * fine)
    chunk = at * fine + F.when(at > 0, F.least(F.greatest(inner, F.lit(0)), F.lit(fine - 1))).otherwise(0)
    return rows.withColumn("chunk", F.coalesce(chunk, F.lit(-1)).cast("long"))


def with_next(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``rows`` with ``chunk``, ``place`` in it, and ``next_text`` of the next row by ``key`` and ``text``, cyclically.

    Rows meet their successors within chunks; each chunk's last row gets the first text of the next chunk.
    """
    rows = in_chunks(rows, key)
    firsts = rows.groupBy("chunk").agg(F.min(key).alias("least"))
    order = Window.orderBy("chunk")  # one row per chunk: COARSE * FINE at most
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = F.coalesce(F.lead("chunk").over(order), F.min("chunk").over(everything))
    firsts = stored(firsts.withColumn("follows", follows), "cws-chunks")
    heads = rows.join(F.broadcast(firsts.select("chunk", "least")), "chunk").where(F.col(key).eqNullSafe(F.col("least")))
    heads = heads.groupBy("chunk").agg(F.min(text).alias("head"))
    heads = firsts.select(F.col("chunk").alias("before"), "follows").join(heads, F.col("follows") == F.col("chunk")).select(
        F.col("before").alias("chunk"), "head")
    in_order = Window.partitionBy("chunk").orderBy(key, text)
    spread = rows.repartition(4 * shuffle_width(rows.sparkSession), "chunk")
    spread = spread.withColumns({"place": F.row_number().over(in_order), "next_text": F.lead(text).over(in_order)})
    return spread.join(heads, "chunk").withColumn("next_text", F.coalesce("next_text", "head")).drop("head")


def fingerprints(documents: DataFrame) -> DataFrame:
    """Every row's fingerprint, that of its edited text, and its likeness to the edited and to the next text.

    The edited text has its last quarter replaced by as many first code points of the next document, by ascending
    ``doc_id`` and text (null ids first; the first follows the last).  Null texts are empty; texts without words share
    one fingerprint; repeated rows follow each other; other columns are ignored; an empty table gives an empty one.
    """
    rows = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = with_next(rows, "doc_id", "text")
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(
        F.expr("left(text, cast(n_chars as int) - cast(floor(n_chars / 4) as int))"),
        F.substring(F.col("next_text"), F.lit(1), quarter)))
    keys = ["chunk", "place"]
    signed = sample_pairs(term_counts(rows, keys, ["text", "edited"]), keys)
    about = rows.select("chunk", "place", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    signed = stored(about.join(signed, keys), "cws-samples")

    firsts = signed.where("place = 1").select(F.col("chunk").alias("follows"), F.col("samples").alias("head"))
    chunks = signed.groupBy("chunk").agg(F.max("place").alias("last"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = F.coalesce(F.lead("chunk").over(Window.orderBy("chunk")), F.min("chunk").over(everything))
    heads = chunks.withColumn("follows", follows).join(firsts, "follows").select("chunk", "head")
    after = F.lead("samples").over(Window.partitionBy("chunk").orderBy("place"))
    found = signed.withColumn("after", after).join(heads, "chunk")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("samples")).alias("fingerprint"),
        as_text(F.col("edited_samples")).alias("edited_fingerprint"),
        likeness(F.col("samples"), F.col("edited_samples")).alias("near_edited"),
        likeness(F.col("samples"), F.coalesce("after", "head")).alias("near_next"))


@query("op5_weighted_samples")
def weighted_samples(spark, folder):
    return fingerprints(table(spark, folder, "documents"))
