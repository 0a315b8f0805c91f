"""The content store as a table: lookup, upsert, expiry, capacity, deletion.

The store holds one row per ``(url_hash, url)``; ``metadata`` is a struct.  Plans that only need to know *which*
entries are concerned read the key columns alone, so page content is neither scanned nor shuffled for them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery import constants as C
from gleanery.functions.urls import url_hash
from gleanery.operators.joins import broadcast_if_small
from gleanery.operators.select import newest_first, nth_row, text_bytes
from gleanery.schemas import METADATA, STORE
from gleanery.session import as_column, checkpointed, stored_table

KEY = ["url_hash", "url"]
PREFIX = "hash_prefix"
_PREFIX_DIGITS = 2


def _moment(as_of: datetime | Column | str) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def parse_created_at(text: Column | str) -> Column:
    """A stored time in any of the three accepted notations; null when unreadable."""
    text = as_column(text)
    formats = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSSXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def meta_to_json(metadata: Column | str) -> Column:
    return F.to_json(as_column(metadata))


def meta_from_json(text: Column | str) -> Column:
    """The metadata struct; null when the text is unreadable (such an entry counts as a miss)."""
    schema = T.StructType([*METADATA.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(as_column(text), schema, {"columnNameOfCorruptRecord": "_corrupt"})
    fields = [F.coalesce(parsed[f.name], F.lit("")).alias(f.name) for f in METADATA.fields]
    return F.when(parsed.isNotNull() & parsed["_corrupt"].isNull(), F.struct(*fields))


def with_key(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("url_hash", url_hash(url))


def is_fresh(as_of: datetime | Column, ttl_days: int = C.STORE_TTL_DAYS, created_at: Column | str = "created_at"):
    """Not older than the time to live; an unreadable time is never fresh."""
    created = as_column(created_at)
    return F.coalesce(created >= _moment(as_of) - F.expr(f"INTERVAL {int(ttl_days)} DAYS"), F.lit(False))


def valid_entries(store: DataFrame, as_of: datetime | Column, ttl_days: int = C.STORE_TTL_DAYS) -> DataFrame:
    return store.where(is_fresh(as_of, ttl_days))


def expired_entries(store: DataFrame, as_of: datetime | Column, ttl_days: int = C.STORE_TTL_DAYS) -> DataFrame:
    return store.where(~is_fresh(as_of, ttl_days))


def cleanup_expired(store: DataFrame, as_of: datetime | Column,
                    ttl_days: int = C.STORE_TTL_DAYS) -> tuple[DataFrame, DataFrame]:
    """``(entries kept, one-row table with the number removed)``."""
    removed = expired_entries(store, as_of, ttl_days).agg(F.count("*").alias("removed"))
    return valid_entries(store, as_of, ttl_days), removed


def narrow_store(store: DataFrame, frontier: DataFrame, url: str = "url") -> DataFrame:
    """The entries a frontier can hit, when it is small enough to broadcast; else the whole store.

    Keeps the content of all other entries out of the join that follows.  Of a store read from files, only the folders
    of the prefixes asked for are listed; there are at most 256 prefixes.
    """
    asked = frontier.select(F.col(url).alias("url")).distinct().select(url_hash("url").alias("url_hash"), "url")
    keys = broadcast_if_small(asked)
    if keys is asked:
        return store
    if PREFIX in store.columns:
        prefixes = [row[0] for row in asked.select(prefix_of("url_hash")).distinct().collect()]
        store = store.where(F.col(PREFIX).isin([p for p in prefixes if p is not None]))
    return store.join(keys, KEY, "left_semi")


def cache_lookup(frontier: DataFrame, store: DataFrame, as_of: datetime | Column,
                 ttl_days: int = C.STORE_TTL_DAYS, url: str = "url", narrow: bool = True) -> DataFrame:
    """Every frontier row with ``hit, content, metadata``.  Hash and URL must both agree."""
    fresh = valid_entries(store, as_of, ttl_days)
    if narrow:
        fresh = narrow_store(fresh, frontier, url)
    known = fresh.select(*KEY, "content", "metadata", F.lit(True).alias("hit"))
    looked_up = frontier.withColumn("url_hash", url_hash(url))
    on = [looked_up["url_hash"] == known["url_hash"], looked_up[url] == known["url"]]
    return looked_up.join(known, on, "left").select(
        *[looked_up[c] for c in frontier.columns], F.coalesce(known["hit"], F.lit(False)).alias("hit"),
        known["content"], known["metadata"],
    )


def cache_hits(frontier: DataFrame, store: DataFrame, as_of: datetime | Column,
               ttl_days: int = C.STORE_TTL_DAYS, url: str = "url", narrow: bool = True) -> DataFrame:
    """Frontier rows answered from the store, with the stored content."""
    return cache_lookup(frontier, store, as_of, ttl_days, url, narrow).where("hit").drop("hit")


def cache_misses(frontier: DataFrame, store: DataFrame, as_of: datetime | Column,
                 ttl_days: int = C.STORE_TTL_DAYS, url: str = "url", narrow: bool = True) -> DataFrame:
    """Frontier rows that still have to be processed.  Reads only the key columns of the store."""
    known = valid_entries(store, as_of, ttl_days)
    if narrow:
        known = narrow_store(known, frontier, url)
    known = known.select(*KEY)
    keyed = frontier.withColumn("_hash", url_hash(url))
    on = [keyed["_hash"] == known["url_hash"], keyed[url] == known["url"]]
    return keyed.join(known, on, "left_anti").drop("_hash")


def latest_writes(writes: DataFrame) -> DataFrame:
    """One row per key: the newest write with content; equal times are settled by a hash of content and metadata."""
    payload = F.struct("content", "metadata", "created_at")
    order = F.struct("created_at", F.xxhash64("content", F.to_json("metadata")))
    return (
        with_key(writes).where(F.col("content") != "")
        .groupBy(*KEY).agg(F.max_by(payload, order).alias("_latest"))
        .select(*KEY, "_latest.content", "_latest.metadata", "_latest.created_at")
    )


def upsert_latest(store: DataFrame, writes: DataFrame) -> DataFrame:
    """Replace by key; the newest entry wins, a write beats a stored entry of the same time.

    The writes are stored once, however they were made.  The store side goes through an anti join on keys and times;
    while the written keys are few enough to broadcast (measured) the content of the store is not shuffled at all.
    """
    new = checkpointed(latest_writes(writes))
    times = broadcast_if_small(new.select(*KEY, "created_at"))
    same_key = (F.col("old.url_hash") == F.col("new.url_hash")) & (F.col("old.url") == F.col("new.url"))
    kept = store.alias("old").join(
        times.alias("new"), same_key & (F.col("new.created_at") >= F.col("old.created_at")), "left_anti"
    )
    old_times = store.select(*KEY, "created_at").join(times.select(*KEY), KEY, "left_semi")
    written = new.alias("new").join(
        old_times.alias("old"), same_key & (F.col("old.created_at") > F.col("new.created_at")), "left_anti"
    )
    columns = [*KEY, "content", "metadata", "created_at"]
    return kept.select(*columns).unionByName(written.select(*columns))


def evict_to_capacity(store: DataFrame, capacity: int) -> DataFrame:
    """The ``capacity`` newest entries; equal times are settled by the key, and an entry without a time is the oldest.

    The last of them is found by histograms over the key columns, written once; all others are kept or left by
    comparison with that one row, so neither keys nor content are sorted, shuffled or joined.
    """
    if capacity <= 0:
        return store.where(F.lit(False))
    hashed, url = F.coalesce("url_hash", F.lit("")), F.coalesce("url", F.lit(""))
    keys = stored_table(store.select(hashed.alias("url_hash"), url.alias("url"), "created_at"), "capacity-keys")
    order = [newest_first(F.col("created_at")), text_bytes(F.col("url_hash")), text_bytes(F.col("url"))]
    last = nth_row(keys, order, capacity)
    if last is None:
        return store
    at = F.lit(last["created_at"]).cast("timestamp")
    by_key = (hashed < last["url_hash"]) | ((hashed == last["url_hash"]) & (url <= last["url"]))
    if last["created_at"] is None:
        return store.where(F.col("created_at").isNotNull() | by_key)
    return store.where((F.col("created_at") > at) | ((F.col("created_at") == at) & by_key))


def delete_expired(store: DataFrame, expired: DataFrame) -> DataFrame:
    """Without the entries whose ``url`` and ``created_at`` are in ``expired``; an entry written again since stays."""
    doomed = expired.select("url", "created_at").distinct().select(url_hash("url").alias("url_hash"), "url", "created_at")
    return store.join(broadcast_if_small(doomed), [*KEY, "created_at"], "left_anti").select(*store.columns)


def delete_keys(store: DataFrame, urls: DataFrame, url: str = "url") -> DataFrame:
    doomed = urls.select(F.col(url).alias("url")).distinct().select(url_hash("url").alias("url_hash"), "url")
    return store.join(broadcast_if_small(doomed), KEY, "left_anti")


def write_store(store: DataFrame, path: str) -> None:
    """Write to a new path, in folders by hash prefix so that lookups of few keys read few of them.

    The rebalance lets adaptive execution cut or merge the shuffled prefixes into files of an even size.
    """
    prefixed = store.withColumn(PREFIX, prefix_of("url_hash"))
    prefixed.hint("rebalance", F.col(PREFIX)).write.mode("error").partitionBy(PREFIX).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    # The prefix is text; left to itself Spark would read prefixes of digits as numbers.
    return spark.read.schema(f"{PREFIX} STRING, {STORE.toDDL()}").parquet(path)


def expire_store(spark: SparkSession, path: str, new_path: str, as_of: datetime | Column,
                 ttl_days: int = C.STORE_TTL_DAYS) -> int:
    """Write the entries that are still fresh to a new path; returns how many were left behind.  Run it on a timer."""
    kept, removed = cleanup_expired(read_store(spark, path).drop(PREFIX), as_of, ttl_days)
    write_store(kept, new_path)
    return removed.first()["removed"]


def prefix_of(hash_column: Column | str) -> Column:
    """The folder of a key; filter on it to prune folders."""
    return F.substring(as_column(hash_column), 1, _PREFIX_DIGITS)
