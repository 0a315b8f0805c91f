"""Counting calls.  Plain aggregations: partial counts per task, then one small shuffle."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import constants as C
from gleanery.session import as_column


def api_calls(df: DataFrame, path: str = "path", code: str | None = None) -> DataFrame:
    """The calls that count: API paths, not rejected.  Failures inside a 200 answer and batches count as one call."""
    counted = df.where(F.col(path).isin(*C.API_PATHS))
    return counted.where(F.col(code) != 429) if code else counted


def call_date(ts: Column | str, zone: str = C.METERING_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(as_column(ts).cast("timestamp"), zone))


def daily_calls(calls: DataFrame, ts: str = "ts", zone: str = C.METERING_ZONE) -> DataFrame:
    """``date, count``."""
    return calls.groupBy(call_date(ts, zone).alias("date")).agg(F.count("*").alias("count"))


def today_calls(daily: DataFrame, as_of: date | Column | str) -> DataFrame:
    """The count of one day, 0 when there is none."""
    day = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
    return daily.where(F.col("date") == day).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"))


def total_calls(daily: DataFrame) -> DataFrame:
    return daily.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"))


def upsert_daily(daily: DataFrame, delta: DataFrame) -> DataFrame:
    """Add the counts of ``delta`` to those of ``daily``."""
    return daily.unionByName(delta).groupBy("date").agg(F.sum("count").alias("count"))
