"""Row shapes shared by the jobs."""

from __future__ import annotations

from pyspark.sql import types as T

METADATA_FIELDS = ("url", "title", "description", "image", "author", "publish_date", "site_name")


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


METADATA = _strings(*METADATA_FIELDS)

RESPONSE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("content_encoding", T.StringType()),
    T.StructField("body", T.BinaryType()),
    T.StructField("fetched_at", T.TimestampType()),
])

CANDIDATE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("selector", T.StringType()),
    T.StructField("metadata", METADATA),
    T.StructField("error", T.StringType()),
])
CANDIDATE_COLUMNS = tuple(CANDIDATE.fieldNames())

STORE = T.StructType([
    T.StructField("url_hash", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("metadata", METADATA),
    T.StructField("created_at", T.TimestampType()),
])

DAILY_CALLS = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("count", T.LongType()),
])

# Saved answers of the reader services.
SCRAPE_JSON = T.StructType([
    T.StructField("success", T.BooleanType()),
    T.StructField("data", T.StructType([
        T.StructField("markdown", T.StringType()),
        T.StructField("metadata", _strings(
            "title", "description", "ogTitle", "ogDescription", "ogImage", "author", "sourceURL")),
    ])),
])

SNAPSHOT_JSON = T.StructType([
    T.StructField("success", T.BooleanType()),
    T.StructField("url", T.StringType()),
    T.StructField("finalUrl", T.StringType()),
    T.StructField("header", _strings(
        "title", "description", "keywords", "author", "charset", "ogTitle", "ogDescription", "ogImage", "ogUrl",
        "twitterCard", "twitterTitle", "twitterDescription", "twitterImage")),
    T.StructField("body", T.StringType()),
])

_SIZED = [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]
TWEET_JSON = T.StructType([
    T.StructField("code", T.IntegerType()),
    T.StructField("tweet", T.StructType([
        T.StructField("url", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("author", _strings("id", "name", "screen_name", "avatar_url")),
        T.StructField("media", T.StructType([
            T.StructField("photos", T.ArrayType(T.StructType([T.StructField("url", T.StringType()), *_SIZED]))),
            T.StructField("videos", T.ArrayType(T.StructType(
                [T.StructField("url", T.StringType()), *_SIZED, T.StructField("thumbnail_url", T.StringType())]))),
        ])),
        T.StructField("likes", T.LongType()),
        T.StructField("retweets", T.LongType()),
        T.StructField("replies", T.LongType()),
    ])),
])

SEARCH_JSON = T.StructType([
    T.StructField("web", T.StructType([
        T.StructField("results", T.ArrayType(T.StructType([
            T.StructField("title", T.StringType()),
            T.StructField("description", T.StringType()),
            T.StructField("url", T.StringType()),
            T.StructField("meta_url", _strings("hostname")),
        ]))),
    ])),
])

PROVIDER_SCHEMAS = {
    "firecrawl": SCRAPE_JSON,
    "webpagesnap": SNAPSHOT_JSON,
    "fxtwitter": TWEET_JSON,
    "brave-search": SEARCH_JSON,
}
