"""The content store, fed with events as writes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.catalog.registry import query, table
from gleanery.functions.html import metadata_struct
from gleanery.operators import buckets as B
from gleanery.operators import store as S
from gleanery.operators import versions as V
from gleanery.session import scratch_path

AS_OF = "2024-01-31 00:00:00"
_MIDDLE = "2024-01-16 00:00:00"
_URL = "'https://site' || (user_id % 97) || '.example/' || user_id"
_CONTENT = "CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN '' ELSE event_type || ' ' || event_id END"

_WRITES_SQL = f"""
    writes AS (SELECT {_URL} AS url, {_CONTENT} AS content, event_type AS title, ts AS created_at FROM events)"""
_LATEST_SQL = """
    SELECT substr(sha256(url), 1, 16) AS url_hash, * FROM writes WHERE content <> ''
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY created_at DESC) = 1"""


def _writes(spark, folder, when: str = "true") -> DataFrame:
    return table(spark, folder, "events").where(when).select(
        F.expr(_URL).alias("url"), F.expr(_CONTENT).alias("content"),
        metadata_struct(title="event_type").alias("metadata"), F.col("ts").cast("timestamp").alias("created_at"),
    )


def _flat(store: DataFrame) -> DataFrame:
    return store.select("url_hash", "url", "content", F.col("metadata.title").alias("title"),
                        F.unix_micros("created_at").alias("created_us"))


_FLAT = "url_hash, url, content, title, epoch_us(created_at) AS created_us"
_FRESH = f"created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


@query("cache_upsert", f"WITH {_WRITES_SQL} SELECT {_FLAT} FROM ({_LATEST_SQL})")
def cache_upsert(spark, folder):
    """Two rounds of writes: the first builds the store, the second replaces by key."""
    store = S.latest_writes(_writes(spark, folder, f"ts < TIMESTAMP_NTZ '{_MIDDLE}'"))
    return _flat(S.upsert_latest(store, _writes(spark, folder, f"ts >= TIMESTAMP_NTZ '{_MIDDLE}'")))


@query("cache_upsert_late", f"WITH {_WRITES_SQL} SELECT {_FLAT} FROM ({_LATEST_SQL})")
def cache_upsert_late(spark, folder):
    """The older half arrives last and must not replace newer entries."""
    store = S.latest_writes(_writes(spark, folder, f"ts >= TIMESTAMP_NTZ '{_MIDDLE}'"))
    return _flat(S.upsert_latest(store, _writes(spark, folder, f"ts < TIMESTAMP_NTZ '{_MIDDLE}'")))


def _store(spark, folder) -> DataFrame:
    return S.latest_writes(_writes(spark, folder))


@query("cache_valid", f"WITH {_WRITES_SQL} SELECT {_FLAT} FROM ({_LATEST_SQL}) WHERE {_FRESH}")
def cache_valid(spark, folder):
    return _flat(S.valid_entries(_store(spark, folder), _as_of()))


@query("cache_expired_count", f"""
    WITH {_WRITES_SQL} SELECT count(*) AS removed FROM writes WHERE NOT ({_FRESH})""")
def cache_expired_count(spark, folder):
    return S.cleanup_expired(_writes(spark, folder), _as_of())[1]


@query("cache_created_at", """
    SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 1 THEN epoch_us(date_trunc('second', ts))
        WHEN event_id % 4 = 2 THEN epoch_us(date_trunc('second', ts)) - 28800000000 ELSE epoch_us(ts) END AS created_us,
        event_id % 4 <> 3 AND CASE WHEN event_id % 4 = 1 THEN date_trunc('second', ts)
        WHEN event_id % 4 = 2 THEN date_trunc('second', ts) - INTERVAL 8 HOURS ELSE ts END
            >= TIMESTAMP '2024-01-24 00:00:00' AS fresh
    FROM events""")
def cache_created_at(spark, folder):
    """Stored times as text in each accepted notation, and an unreadable one."""
    text = F.expr("""CASE event_id % 4 WHEN 0 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        WHEN 1 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') WHEN 2 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+08:00'")
        ELSE 'yesterday' END""")
    read = table(spark, folder, "events").select("event_id", S.parse_created_at(text).alias("created_at"))
    return read.select("event_id", F.unix_micros("created_at").alias("created_us"), S.is_fresh(_as_of()).alias("fresh"))


_ASKED = f"CASE WHEN event_id % 3 = 0 THEN 'https://new.example/' || event_id ELSE {_URL} END"
_FRONTIER_SQL = f"frontier AS (SELECT event_id, {_ASKED} AS url FROM events)"


def _frontier(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.expr(_ASKED).alias("url"))


@query("cache_lookup", f"""
    WITH {_WRITES_SQL}, {_FRONTIER_SQL}, store AS ({_LATEST_SQL})
    SELECT event_id, f.url, s.url IS NOT NULL AS hit, content, title
    FROM frontier f LEFT JOIN (SELECT * FROM store WHERE {_FRESH}) s ON f.url = s.url""")
def cache_lookup(spark, folder):
    found = S.cache_lookup(_frontier(spark, folder), _store(spark, folder), _as_of())
    return found.select("event_id", "url", "hit", "content", F.col("metadata.title").alias("title"))


@query("cache_hits", f"""
    WITH {_WRITES_SQL}, {_FRONTIER_SQL}, store AS ({_LATEST_SQL})
    SELECT event_id, f.url, content FROM frontier f JOIN (SELECT * FROM store WHERE {_FRESH}) s ON f.url = s.url""")
def cache_hits(spark, folder):
    return S.cache_hits(_frontier(spark, folder), _store(spark, folder), _as_of()).select("event_id", "url", "content")


@query("cache_misses", f"""
    WITH {_WRITES_SQL}, {_FRONTIER_SQL}, store AS ({_LATEST_SQL})
    SELECT event_id, url FROM frontier WHERE url NOT IN (SELECT url FROM store WHERE {_FRESH})""")
def cache_misses(spark, folder):
    return S.cache_misses(_frontier(spark, folder), _store(spark, folder), _as_of())


@query("cache_capacity", f"""
    WITH {_WRITES_SQL} SELECT {_FLAT} FROM ({_LATEST_SQL}) ORDER BY created_at DESC, url_hash, url LIMIT 100""")
def cache_capacity(spark, folder):
    return _flat(S.evict_to_capacity(_store(spark, folder), 100))


@query("cache_delete", f"""
    WITH {_WRITES_SQL} SELECT {_FLAT} FROM ({_LATEST_SQL}) WHERE url NOT IN (
        SELECT {_URL} FROM events WHERE event_type = 'error' AND value > 60)""")
def cache_delete(spark, folder):
    doomed = table(spark, folder, "events").where("event_type = 'error' AND value > 60").select(F.expr(_URL).alias("url"))
    return _flat(S.delete_keys(_store(spark, folder), doomed))


@query("cache_metadata_json", f"""
    WITH {_WRITES_SQL} SELECT url, content, CASE WHEN content LIKE '%7' THEN NULL ELSE title END AS title,
        content NOT LIKE '%7' AS readable FROM ({_LATEST_SQL})""")
def cache_metadata_json(spark, folder):
    """Metadata through its JSON form; an unreadable text is a miss."""
    text = F.when(F.col("content").endswith("7"), "{broken").otherwise(S.meta_to_json("metadata"))
    read = _store(spark, folder).select("url", "content", S.meta_from_json(text).alias("m"))
    return read.select("url", "content", "m.title", F.col("m").isNotNull().alias("readable"))


@query("store_round_trip", f"WITH {_WRITES_SQL} SELECT {_FLAT} FROM ({_LATEST_SQL})")
def store_round_trip(spark, folder):
    path = scratch_path(spark, "store")
    S.write_store(_store(spark, folder), path)
    return _flat(S.read_store(spark, path))


_CUTS = ("2024-01-11 00:00:00", "2024-01-21 00:00:00", "9999-01-01 00:00:00")


@query("store_versions", f"""
    WITH {_WRITES_SQL}, cuts AS (SELECT v, cut FROM (VALUES
        (0, TIMESTAMP '{_CUTS[0]}'), (1, TIMESTAMP '{_CUTS[1]}'), (2, TIMESTAMP '{_CUTS[2]}')) c(v, cut))
    SELECT v AS version, url, content, title, epoch_us(created_at) AS created_us
    FROM writes JOIN cuts ON created_at < cut WHERE content <> ''
    QUALIFY row_number() OVER (PARTITION BY v, url ORDER BY created_at DESC) = 1""")
def store_versions(spark, folder):
    """A store written whole and two upserts; every version is read as it was."""
    root = scratch_path(spark, "versions")
    parts = [_writes(spark, folder, f"ts >= TIMESTAMP_NTZ '{low}' AND ts < TIMESTAMP_NTZ '{high}'")
             for low, high in zip(("0001-01-01 00:00:00", *_CUTS), _CUTS)]
    V.write_whole(S.latest_writes(parts[0]), root, target_bytes=4 << 10)
    for part in parts[1:]:
        V.upsert_version(spark, root, part)
    read = [_flat(V.read_version(spark, root, v)).select(F.lit(v).alias("version"), "url", "content", "title", "created_us")
            for v in range(3)]
    return reduce(DataFrame.unionByName, read)


@query("store_versions_expired", f"""
    WITH {_WRITES_SQL} SELECT {_FLAT} FROM ({_LATEST_SQL}) WHERE {_FRESH} AND url NOT IN (
        SELECT {_URL} FROM events WHERE event_type = 'error' AND value > 60)""")
def store_versions_expired(spark, folder):
    """Entries deleted, then the expired ones, prefix by prefix."""
    root = scratch_path(spark, "versions")
    V.write_whole(_store(spark, folder), root, target_bytes=4 << 10)
    doomed = table(spark, folder, "events").where("event_type = 'error' AND value > 60").select(F.expr(_URL).alias("url"))
    V.delete_version(spark, root, doomed)
    V.expire_version(spark, root, _as_of())
    return _flat(V.read_version(spark, root))


def _bucketed(spark, folder) -> DataFrame:
    name = f"gleanery_store_{uuid.uuid4().hex}"
    return B.write_bucketed(_store(spark, folder), name, scratch_path(spark, "bucketed"), buckets=8)


@query("cache_lookup_bucketed", f"""
    WITH {_WRITES_SQL}, {_FRONTIER_SQL}, store AS ({_LATEST_SQL})
    SELECT event_id, f.url, s.url IS NOT NULL AS hit, content, title
    FROM frontier f LEFT JOIN (SELECT * FROM store WHERE {_FRESH}) s ON f.url = s.url""")
def cache_lookup_bucketed(spark, folder):
    found = B.lookup_bucketed(_frontier(spark, folder), _bucketed(spark, folder), _as_of())
    return found.select("event_id", "url", "hit", "content", F.col("metadata.title").alias("title"))


@query("cache_misses_bucketed", f"""
    WITH {_WRITES_SQL}, {_FRONTIER_SQL}, store AS ({_LATEST_SQL})
    SELECT event_id, url FROM frontier WHERE url NOT IN (SELECT url FROM store WHERE {_FRESH})""")
def cache_misses_bucketed(spark, folder):
    return B.misses_bucketed(_frontier(spark, folder), _bucketed(spark, folder), _as_of())
