"""Saved crawl responses and pages: scan, status gate, decompression and charset repair."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.text import or_empty
from gleanery.schemas import RESPONSE
from gleanery.session import as_column

READ_FAILED = "读取响应失败"
_GZIP_MAGIC = b"\x1f\x8b"
_DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages: ``page_id, url, html``."""
    return spark.read.parquet(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Saved responses with the fixed schema, so no file is opened to infer one."""
    return spark.read.schema(RESPONSE).parquet(path)


def status_error(status: Column | str) -> Column:
    """``HTTP n`` for any status but 200."""
    status = F.coalesce(as_column(status), F.lit(0))
    return F.when(status != 200, F.concat(F.lit("HTTP "), status.cast("string")))


def _decode_udf(max_bytes: int | None):
    def full(parts: list[bytes]) -> bool:
        return max_bytes is not None and sum(map(len, parts)) > max_bytes

    def room(parts: list[bytes]) -> int:
        return 0 if max_bytes is None else max_bytes + 1 - sum(map(len, parts))  # 0: as much as there is

    @F.arrow_udf(returnType=_DECODED)
    def decode(body: pa.Array) -> pa.Array:
        texts, errors = [], []
        for item in body:
            text = error = None
            raw = item.as_py()
            if raw is not None:
                try:
                    if raw[:2] == _GZIP_MAGIC:
                        parts = []
                        while raw:  # a gzip body may have several members
                            member = zlib.decompressobj(31)
                            parts.append(member.decompress(raw, room(parts)))
                            if not member.eof and not full(parts):
                                raise zlib.error("truncated")
                            raw = b"" if full(parts) else member.unused_data
                        raw = b"".join(parts)
                    if max_bytes is not None and len(raw) > max_bytes:
                        error = f"response body over {max_bytes} bytes"
                    else:
                        try:
                            text = raw.decode("utf-8")
                        except UnicodeDecodeError:
                            text = raw.decode("gbk", "replace")
                except zlib.error:
                    error = READ_FAILED
            texts.append(text)
            errors.append(error)
        return pa.StructArray.from_arrays(
            [pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["text", "error"]
        )

    return decode.asNondeterministic()


def decode_body(df: DataFrame, body: str = "body", encoding: str | None = "content_encoding",
                max_bytes: int | None = None) -> DataFrame:
    """Replace ``body`` by ``text`` and ``decode_error``.

    Valid UTF-8 never leaves the JVM; only gzip and GBK bodies are handed to Python.  A body that cannot
    be decoded, or is larger than ``max_bytes`` where that is given, keeps its row, with an error.
    """
    raw = F.col(body)
    kind = F.lower(or_empty(F.col(encoding))) if encoding else F.lit("")
    is_gzip = F.coalesce(F.substring(raw, 1, 2) == F.lit(_GZIP_MAGIC), F.lit(False))
    unsupported = kind.isin("br", "deflate")
    too_large = F.lit(False) if max_bytes is None else ~is_gzip & (F.octet_length(raw) > max_bytes)
    plain = ~is_gzip & F.is_valid_utf8(raw.cast("string"))
    handed_over = F.when(~unsupported & ~too_large & ~plain, raw)
    rest = [c for c in df.columns if c != body]
    return (
        df.select(*rest, raw, _decode_udf(max_bytes)(handed_over).alias("_decoded"))
        .select(
            *rest,
            F.when(unsupported | too_large, F.lit(None).cast("string"))
            .when(plain, raw.cast("string")).otherwise(F.col("_decoded.text")).alias("text"),
            F.when(unsupported, F.concat(F.lit("unsupported content encoding: "), kind))
            .when(too_large, F.lit(f"response body over {max_bytes} bytes"))
            .otherwise(F.col("_decoded.error")).alias("decode_error"),
        )
    )


def responses_to_pages(responses: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``url, html, content_type, fetched_at, error`` of each saved response; failed ones have no html."""
    decoded = decode_body(responses.withColumn("_status_error", status_error("status")), max_bytes=max_bytes)
    error = F.coalesce(F.col("_status_error"), F.col("decode_error"))
    return decoded.select(
        "url",
        F.when(error.isNull(), F.col("text")).alias("html"),
        or_empty(F.col("content_type")).alias("content_type"),
        "fetched_at",
        error.alias("error"),
    )
