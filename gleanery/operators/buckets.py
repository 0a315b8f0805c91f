"""The content store as a bucketed table, for frontiers too large to broadcast: its entries never leave their buckets.

Only the distinct URLs asked for are shuffled to the buckets, after they were reduced in their tasks; so a URL that a
third of the frontier asks for is one row of the join, and adaptive execution may split it when answers go back.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import constants as C
from gleanery.functions.urls import url_hash
from gleanery.operators.joins import join_back
from gleanery.operators.store import KEY, valid_entries
from gleanery.schemas import STORE

TARGET_BYTES = 256 << 20


def bucket_count(store: DataFrame, target_bytes: int = TARGET_BYTES) -> int:
    """Buckets of about ``target_bytes`` of content, measured."""
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    total = store.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()["bytes"]
    return max(1, -(-total // target_bytes))


def write_bucketed(store: DataFrame, name: str, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """Write ``store`` as table ``name``, at ``path`` if given, bucketed and sorted by its key."""
    buckets = buckets or bucket_count(store)
    # One task for each bucket: a bucket is one file.
    dealt = store.select(*STORE.fieldNames()).repartition(buckets, *KEY)
    writer = dealt.write.mode("error").format("parquet").bucketBy(buckets, *KEY).sortBy(*KEY)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return store.sparkSession.table(name)


def _asked(frontier: DataFrame, url: str) -> DataFrame:
    asked = frontier.select(F.col(url).alias("url")).where("url IS NOT NULL").distinct()
    # A hint, or Spark may broadcast the store's side of a small table.
    return asked.select(url_hash("url").alias("url_hash"), "url").hint("merge")


def lookup_bucketed(frontier: DataFrame, store: DataFrame, as_of: datetime | Column,
                    ttl_days: int = C.STORE_TTL_DAYS, url: str = "url") -> DataFrame:
    """:func:`gleanery.operators.store.cache_lookup` on a table of :func:`write_bucketed`."""
    fresh = valid_entries(store, as_of, ttl_days).select(*KEY, "content", "metadata")
    found = _asked(frontier, url).join(fresh, KEY).select(
        F.col("url").alias(url), F.lit(True).alias("hit"), "content", "metadata")
    rows = join_back(frontier, found, [url])
    return rows.withColumn("hit", F.coalesce("hit", F.lit(False))).select(*frontier.columns, "hit", "content", "metadata")


def misses_bucketed(frontier: DataFrame, store: DataFrame, as_of: datetime | Column,
                    ttl_days: int = C.STORE_TTL_DAYS, url: str = "url") -> DataFrame:
    """:func:`gleanery.operators.store.cache_misses` on a table of :func:`write_bucketed`; reads keys and times alone."""
    known = valid_entries(store, as_of, ttl_days).select(*KEY)
    missed = _asked(frontier, url).join(known, KEY, "left_anti").select(F.col("url").alias("_missed"))
    return frontier.join(missed, frontier[url] == missed["_missed"], "left_semi").unionByName(frontier.where(F.col(url).isNull()))
