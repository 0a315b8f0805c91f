"""Arrivals that count, over a whole table: a URL's first, then each first one more than the time to live after the last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery import constants as C
from gleanery.operators.scan import chunked, running_max
from gleanery.session import stored_table

DAY = 86_400_000_000


def next_arrivals(times: DataFrame, life_us: int, chunks: int | None = None) -> DataFrame:
    """``_owner, us, next``: the first time of the owner that is more than ``life_us`` later, null if there is none.

    ``times`` holds each ``(_owner, us)`` once.  One running value from the latest time to the earliest, carried from chunk
    to chunk, so an owner with very many times is spread over many tasks.
    """
    both = times.select("_owner", F.inline(F.array(
        F.struct((-F.col("us")).alias("_back"), F.lit(1).alias("_kind"), F.col("us").alias("_time"), F.lit(None).cast("long").alias("us")),
        F.struct((-F.col("us") - life_us).alias("_back"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_time"), F.col("us")),
    )))
    # Going back in time; at one moment the question comes before the arrival, which is not later.
    pieces = chunked(both, ["_owner", "_back", "_kind"], chunks)
    found = running_max(pieces, ["_owner"], ["_back", "_kind"], -F.col("_time"), "_least")
    return found.where("_kind = 0").select("_owner", "us", (-F.col("_least")).alias("next"))


def reached(pointers: DataFrame) -> tuple[DataFrame, int]:
    """``_owner, us`` of all times on the way from each owner's first along ``next``, and the rounds it took.

    Pointers double: a round adds as many steps as there were, so the longest way of n steps takes about log n rounds.
    """
    jumps = pointers.where("next IS NOT NULL")
    found = stored_table(pointers.groupBy("_owner").agg(F.min("us").alias("us")), "arrivals-reached")
    rounds = 0
    while True:
        rounds += 1
        new = stored_table(found.join(jumps, ["_owner", "us"]).select("_owner", F.col("next").alias("us")), "arrivals-reached")
        if not new.limit(1).count():
            return found, rounds
        found = found.unionByName(new)
        then = jumps.select("_owner", F.col("us").alias("next"), F.col("next").alias("then"))
        jumps = stored_table(
            jumps.join(then, ["_owner", "next"]).select("_owner", "us", F.col("then").alias("next")), "arrivals-jumps")


def dedup_arrivals(arrivals: DataFrame, url: str = "url", ts: str = "ts", ttl_days: int = C.STORE_TTL_DAYS,
                   chunks: int | None = None) -> DataFrame:
    """``url, ts`` of the arrivals that count: each URL's first, then the first more than ``ttl_days`` after the last kept.

    The batch twin of :func:`gleanery.streaming.pages.dedup_stream`.  Arrivals of one moment are one; those without a
    time never count; a null URL is a URL of its own.
    """
    times = arrivals.where(F.col(ts).isNotNull()).select(
        F.struct(F.col(url).alias("url")).alias("_owner"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).distinct()
    pointers = stored_table(next_arrivals(times, ttl_days * DAY, chunks), "arrivals-next")
    kept, _ = reached(pointers)
    return kept.select("_owner.url", F.timestamp_micros("us").alias("ts"))
