"""JSON results, one per URL or one per batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import constants as C
from gleanery.functions.text import non_empty, trunc2
from gleanery.session import as_column

_ITEM_FIELDS = (
    "url", "title", "content", "metadata", "mode", "fetch_time", "content_length", "selector_matched", "success",
)


def _fetch_time(df: DataFrame) -> Column:
    return F.col("fetch_time") if "fetch_time" in df.columns else F.lit(0.0)


def to_envelope(results: DataFrame) -> DataFrame:
    """Add ``json``: code 200 with the result, or code 500 with the error."""
    data = F.struct(
        "url", "title", "content", "mode", trunc2(_fetch_time(results)).alias("fetch_time"), "content_length",
        "metadata",
    )
    missing = F.coalesce(F.col("request_url"), F.lit("")) == ""
    return results.withColumn(
        "json",
        F.when(missing, F.to_json(F.struct(F.lit(400).alias("code"), F.lit(C.MSG_MISSING_URL).alias("message"))))
        .when(
            F.col("success"),
            F.to_json(F.struct(F.lit(200).alias("code"), F.lit(C.MSG_SUCCESS).alias("message"), data.alias("data"))),
        ).otherwise(F.to_json(F.struct(F.lit(500).alias("code"), F.col("error").alias("message")))),
    )


def batch_item_json(results: DataFrame) -> Column:
    """One element of a batch answer; a failure has three fields only."""
    fields = [
        _fetch_time(results).alias(n) if n == "fetch_time"
        else non_empty(F.col(n)).alias(n) if n == "selector_matched" else F.col(n)
        for n in _ITEM_FIELDS
    ]
    failed = F.struct("url", "success", non_empty(F.col("error")).alias("error"))
    return F.when(F.col("success"), F.to_json(F.struct(*fields))).otherwise(F.to_json(failed))


def to_batch_envelope(batches: DataFrame, items: str = "items") -> DataFrame:
    """Add ``json`` from an array column of element strings already in request order; ``too_large`` gives code 400."""
    answer = F.concat(
        F.lit('{"code":200,"message":"' + C.MSG_SUCCESS + '","data":['), F.array_join(F.col(items), ","), F.lit("]}")
    )
    refused = F.to_json(F.struct(F.lit(400).alias("code"), F.lit(C.MSG_BATCH_TOO_LARGE).alias("message")))
    return batches.withColumn("json", F.when(F.col("too_large"), refused).otherwise(answer))


def rejection_json(code: Column | str = "code") -> Column:
    """The answer to a call that was not admitted; null for any other."""
    refused = F.struct(F.lit(429).alias("code"), F.lit(C.MSG_RATE_LIMITED).alias("message"))
    return F.when(as_column(code) == 429, F.to_json(refused))
