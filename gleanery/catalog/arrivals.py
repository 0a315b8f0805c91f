"""Arrivals that count, over the whole table at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.catalog.registry import query, table
from gleanery.catalog.streams import DEDUP_SQL
from gleanery.operators.arrivals import dedup_arrivals


@query("batch_dedup", DEDUP_SQL)
def batch_dedup(spark, folder):
    arrivals = table(spark, folder, "events").select("ts", F.expr("'https://site.example/' || user_id").alias("url"))
    return dedup_arrivals(arrivals).select("url", F.unix_micros("ts").alias("us"))
