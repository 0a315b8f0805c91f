"""Call counts and rates as streams: the key of each call, to be counted by a sink that adds up micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery import constants as C
from gleanery.operators.metering import call_date


def stream_daily_calls(calls: DataFrame, ts: str = "ts", zone: str = C.METERING_ZONE) -> DataFrame:
    """``date`` of each call in the zone; count it with :func:`gleanery.streaming.files.count_sink`."""
    return calls.select(call_date(ts, zone).alias("date"))


def stream_rate(calls: DataFrame, ts: str = "ts", width: str = "1 second") -> DataFrame:
    """``second``, the start of the tumbling window each call falls into."""
    return calls.select(F.window(F.col(ts).cast("timestamp"), width).start.alias("second"))
