"""Page arrivals as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery import constants as C
from gleanery.operators.extract import extract_content
from gleanery.streaming.files import use_rocksdb
from gleanery.streaming.grouped import EMITTED, Lives, in_groups


class _Kept(Lives):
    """The time of a URL is that of its last arrival that counted."""

    def taken(self, known: dict, url: str | None, us: int) -> int | None:
        last = known.get(url)
        if last is not None and us <= last + self.life:
            return None
        known[url] = us
        return us


def dedup_stream(arrivals: DataFrame, url: str = "url", ts: str = "ts", ttl_days: int = C.STORE_TTL_DAYS,
                 late: str = "1 day") -> DataFrame:
    """``url, ts`` of the arrivals that count: each URL's first, then the first more than ``ttl_days`` after the last kept.

    The state of a URL is the time of its last kept arrival.  It is dropped once the watermark is so far past it that
    no arrival up to ``late`` behind can be a copy of it any more.  An arrival older than the last kept one is a copy.
    """
    use_rocksdb(arrivals.sparkSession)
    timed = arrivals.select(F.col(url).alias("url"), F.col(ts).cast("timestamp").alias("ts")).where("ts IS NOT NULL")
    timed = timed.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    kept = in_groups(timed, "url").transformWithStateInPandas(
        _Kept(ttl_days * 86_400_000_000), EMITTED, "Append", "EventTime")
    return kept.select("url", F.timestamp_micros("us").alias("ts"))


def stream_extract(pages: DataFrame, **options) -> DataFrame:
    """The batch extraction, applied to arriving pages."""
    return extract_content(pages, **options)
