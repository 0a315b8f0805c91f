"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The words of a source, in a seeded order of its documents, are dealt into shards and cut into blocks of equal length.
Blocks are seats: sources get them by highest quotients ``target / (2 k + 1)``, and the shards of a source share its
seats in the same way.  Inside a shard the seats choose blocks by seeded systematic selection.  That choice has a
closed form, so neither quotients nor blocks ever become rows beyond a few per source or shard, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.registry import query, table
from gleanery.llm.text import stored, word_count

BLOCK_WORDS = 64
SHARD_WORDS = 1 << 16
# The shards of one source are ranked together; beyond this many they get longer instead.
MOST_SHARDS = 1 << 16
MOST_REPEATS = 3
SEED = 20240607


def shared_out(rows: DataFrame, group: list[str], weight: str, limit: str, total: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: each group's ``total`` by ``weight``, nobody above ``limit``, the excess going to the others.

    Sorted by ``limit / weight``, those at their limit come first, which makes the resharing a running sum.
    """
    in_group = Window.partitionBy(*group)
    ratio = F.when(F.col(weight) > 0, F.col(limit) / F.col(weight)).otherwise(float("inf"))
    before = in_group.orderBy("__ratio", "__no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"__ratio": ratio, "__total": total.cast("double")})
    rows = rows.withColumn("__no", F.row_number().over(in_group.orderBy("__ratio")))
    left = F.col("__total") - F.coalesce(F.sum(F.col(limit).cast("double")).over(before), F.lit(0.0))
    open_weight = F.sum(weight).over(in_group) - F.coalesce(F.sum(weight).over(before), F.lit(0.0))
    rows = rows.withColumn("__share", F.when(open_weight > 0, left / open_weight).otherwise(0.0))
    rows = rows.withColumn("__at_limit", F.col(limit) < F.col("__share") * F.col(weight))
    # The share that holds for all below their limit is that of the first of them.
    first_open = F.min(F.when(~F.col("__at_limit"), F.struct("__ratio", "__no", "__share"))).over(in_group)
    part = F.when(F.col("__at_limit"), F.col(limit).cast("double")).otherwise(first_open["__share"] * F.col(weight))
    return rows.withColumn(name, part).drop("__ratio", "__total", "__no", "__share", "__at_limit")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = MOST_REPEATS) -> DataFrame:
    """One row per source of ``(source, size)``: ``source, source_no, source_size, target``.

    Sources by code point, null last, weigh ``weights`` in turn and share all words; no target exceeds ``most`` times
    its source, the excess going to the others by weight.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("all", F.lit(1))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("source_no", F.row_number().over(named).cast("long"))
    turn = F.pmod(F.col("source_no") - 1, F.lit(len(weights))).cast("int") + 1
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
    sources = sources.withColumn("limit", F.col("source_size").cast("double") * most)
    everything = F.sum("source_size").over(Window.partitionBy("all"))
    return shared_out(sources, ["all"], "weight", "limit", everything, "target").select(
        "source", "source_no", "source_size", "target")


def sainte_lague(parties: DataFrame, group: list[str], name: str, weight: str, seats: str, most: str) -> DataFrame:
    """``group, name, quota``: the seats of each group go to its parties by highest quotients, at most ``most`` each.

    Sharing half a seat per party less, and then rounding, gives nobody too many; sharing half a seat more gives nobody
    too few.  Only the quotients between, about one per party, are ranked.  Equal quotients go to the smaller ``name``.
    """
    in_group = Window.partitionBy(*group)
    parties = parties.select(
        *group, name, F.col(weight).cast("double").alias("_w"), F.col(seats).alias("_seats"), F.col(most).alias("_most"),
        F.count(F.lit(1)).over(in_group).alias("_n"))
    for bound, change in (("_low", -F.col("_n") / 2), ("_high", F.col("_n") / 2 + 1)):
        parties = shared_out(parties, group, "_w", "_most", F.col("_seats") + change, bound)
    low = F.floor(F.greatest(F.col("_low"), F.lit(0.0)) + 0.5 - 1e-9)
    high = F.when(F.col("_w") > 0, F.ceil(F.col("_high") + 0.5)).otherwise(0)
    parties = parties.withColumns({"_low": F.least(low, "_most"), "_high": F.least(high, "_most")})
    parties = parties.withColumn("_left", F.col("_seats") - F.sum("_low").over(in_group))
    next_seats = F.when(F.col("_high") > F.col("_low"), F.sequence("_low", F.col("_high") - 1))
    rows = parties.select(*group, name, "_w", "_low", "_left", F.explode_outer(next_seats).alias("_k"))
    best = in_group.orderBy((F.col("_w") / (2 * F.col("_k") + 1)).desc_nulls_last(), name)
    won = F.col("_k").isNotNull() & (F.row_number().over(best) <= F.col("_left"))
    return rows.withColumn("_won", won.cast("long")).groupBy(*group, name).agg(
        (F.first("_low") + F.sum("_won")).cast("long").alias("quota"))


def _below(position: Column) -> Column:
    """Words of the chosen extra blocks that lie before ``position`` of the shard."""
    block = F.floor(position / F.col("block"))
    chosen = lambda b: _div(b * F.col("extra") + F.col("offset"), F.col("n_blocks"))
    return F.col("block") * chosen(block) + (chosen(block + 1) - chosen(block)) * (position - block * F.col("block"))


def _div(a: Column, b: Column) -> Column:
    """Whole-number division that stays exact for large longs."""
    return F.call_function("div", a, b)


def mix_plan(
    documents: DataFrame, weights: tuple[float, ...] = (1, 2, 3), *, block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS, seed: int = SEED,
) -> DataFrame:
    """``documents`` (``doc_id, source, size`` and more) with what the mix takes of each.

    Added: ``source_size, target, taken``; and the place of the document in its shard, from which the taken words
    follow: ``start, block, n_blocks, rounds, extra, offset``.  All words are taken ``rounds`` times, and block ``b``
    once more where ``(b * extra + offset) div n_blocks`` changes from ``b`` to ``b + 1``.

    A null source is a source of its own, sizes of null count as 0, repeated rows are separate documents, an empty
    table gives an empty one.  Sources whose words are few get what whole blocks can give them.
    """
    rows = documents.withColumn("size", F.coalesce(F.col("size"), F.lit(0)).cast("long"))
    narrow = stored(rows.select("doc_id", "source", "size"), "mix-sizes")
    sources = source_targets(narrow, weights)
    shards_of = F.least(F.lit(MOST_SHARDS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)))
    sources = stored(sources.withColumn("n_shards", shards_of.cast("long")), "mix-sources")

    def dealt(df: DataFrame) -> DataFrame:
        marked = df.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        return marked.drop("_source").withColumn(
            "shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("n_shards")))

    # Equal lengths that come out nearly even: the last block of a shard is shorter by a few words at most.
    shards = dealt(narrow).groupBy("source_no", "source", "shard", "target").agg(F.sum("size").alias("shard_size"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block_words))
    shards = shards.withColumn("block", F.greatest(F.lit(1), F.ceil(F.col("shard_size") / blocks)).cast("long"))
    shards = shards.withColumn("n_blocks", F.ceil(F.col("shard_size") / F.col("block")).cast("long"))
    shards = stored(shards.withColumn("most", F.col("n_blocks") * MOST_REPEATS), "mix-shards")

    parties = shards.groupBy("source_no").agg(F.first("target").alias("target"), F.sum("most").alias("most"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parties = parties.withColumns({
        "seats": F.round(F.sum("target").over(everything) / block_words).cast("long"), "all": F.lit(1)})
    source_quota = sainte_lague(parties, ["all"], "source_no", "target", "seats", "most")
    parties = shards.join(source_quota.select("source_no", F.col("quota").alias("seats")), "source_no")
    quota = sainte_lague(parties, ["source_no"], "shard", "shard_size", "seats", "most")
    offset = F.pmod(F.xxhash64(F.lit(seed + 1), "source", "shard"), F.greatest(F.lit(1), F.col("n_blocks")))
    quota = shards.join(quota, ["source_no", "shard"]).select(
        "source_no", "shard", "block", F.greatest(F.lit(1), F.col("n_blocks")).alias("n_blocks"), "quota",
        offset.alias("offset"))
    quota = stored(quota.withColumns({
        "rounds": _div(F.col("quota"), F.col("n_blocks")), "extra": F.col("quota") % F.col("n_blocks")}), "mix-quotas")

    order = Window.partitionBy("source_no", "shard").orderBy(
        F.xxhash64(F.lit(seed + 2), "doc_id"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt(rows).withColumn("end", F.sum("size").over(order)).withColumn("start", F.col("end") - F.col("size"))
    placed = placed.join(quota, ["source_no", "shard"])
    taken = F.col("rounds") * F.col("size") + _below(F.col("end")) - _below(F.col("start"))
    return placed.withColumn("taken", taken.cast("long")).drop("source_no", "n_shards", "end")


def mixed(documents: DataFrame, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """The mix itself, with the columns of ``documents``: each text as often as whole rounds take it, and once more the
    words of the blocks chosen beyond them.  ``n_chars`` is counted anew for partial texts where it exists.
    """
    rows = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct("*").alias("__row"))
    plan = mix_plan(rows, weights).withColumn("__more", F.col("taken") - F.col("rounds") * F.col("size"))
    whole = F.col("rounds") + (F.col("__more") == F.col("size")).cast("long")
    copies = F.when((whole > 0) & (F.col("size") > 0), F.array_repeat(F.lit(False), whole.cast("int"))).otherwise(
        F.array().cast("array<boolean>"))
    part = F.when((F.col("__more") > 0) & (F.col("__more") < F.col("size")), F.array(F.lit(True))).otherwise(
        F.array().cast("array<boolean>"))
    plan = plan.select("*", F.explode(F.concat(copies, part)).alias("__part"))

    def chosen(_: Column, n: Column) -> Column:
        block = _div(F.col("start") + n, F.col("block"))
        count = lambda b: _div(b * F.col("extra") + F.col("offset"), F.col("n_blocks"))
        return count(block + 1) > count(block)

    pieces = F.regexp_extract_all(F.col("__row.text"), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    text = F.when(F.col("__part"), F.rtrim(F.array_join(F.filter(pieces, chosen), ""))).otherwise(F.col("__row.text"))
    made = plan.select("__part", text.alias("__text"), "__row.*").withColumn("text", F.col("__text"))
    if "n_chars" in documents.columns:
        size = F.length("__text").cast(documents.schema["n_chars"].dataType)
        made = made.withColumn("n_chars", F.when(F.col("__part"), size).otherwise(F.col("n_chars")))
    return made.select(*documents.columns)


@query("op2_sainte_lague_mix")
def sainte_lague_mix(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix_plan(documents).select("doc_id", "size", "source_size", "target", "taken", "source", "shard", "quota")
