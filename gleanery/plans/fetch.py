"""The whole way from a frontier of URLs to results."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import constants as C
from gleanery.functions.html import metadata_struct
from gleanery.functions.text import non_empty
from gleanery.functions.urls import url_error
from gleanery.operators.cascade import batch_items, candidate_is_valid, failure_error, weigh_candidates
from gleanery.operators.joins import broadcast_if_small
from gleanery.operators.store import cache_lookup, cache_misses, narrow_store, upsert_latest
from gleanery.schemas import METADATA
from gleanery.session import checkpointed
from gleanery.sources.envelope import batch_item_json, to_batch_envelope

RESULT_COLUMNS = (
    "request_url", "url", "title", "content", "metadata", "mode", "content_length", "selector_matched", "success",
    "error",
)


def fetch_results(frontier: DataFrame, candidates: DataFrame, store: DataFrame | None = None,
                  as_of: datetime | Column | None = None, url: str = "url",
                  available: Iterable[str] = C.ALL_MODES, force_stealth: bool = False) -> DataFrame:
    """One result per distinct URL: ``invalid``, ``cached``, the best candidate, or ``failed``.

    Leave ``store`` out to skip the lookup.  Candidates of URLs that are invalid or in the store are dropped before
    the aggregation, by a semi join on keys.
    """
    available = tuple(available)
    asked = frontier.select(F.col(url).alias("url")).distinct().withColumn("_problem", url_error("url"))
    wanted = asked.where(F.col("_problem").isNull()).select("url")
    if store is None:
        known = asked.select("*", F.lit(False).alias("hit"), F.lit(None).cast("string").alias("content"),
                             F.lit(None).cast(METADATA).alias("metadata"))
    else:
        near = narrow_store(store, wanted)
        known = cache_lookup(asked, near, as_of, narrow=False)
        wanted = cache_misses(wanted, near, as_of, narrow=False)
    weighed = weigh_candidates(candidates.join(wanted, "url", "left_semi"), available, force_stealth)
    rows = known.join(weighed, "url", "left")

    invalid, cached = F.col("_problem").isNotNull(), F.col("hit")
    found = ~invalid & ~cached & F.col("_best").isNotNull()
    best = F.col("_best")
    metadata = (
        F.when(invalid, metadata_struct()).when(cached, F.col("metadata")).when(found, best["metadata"])
        .otherwise(metadata_struct(url="url"))
    )
    content = F.when(invalid, "").when(cached, F.col("content")).when(found, best["content"]).otherwise("")
    error = (
        F.when(invalid, F.concat(F.lit(C.MSG_URL_INVALID), F.col("_problem")))
        .when(~cached & ~found, failure_error("url", available, force_stealth))
    )
    chosen = rows.select(
        F.col("url").alias("request_url"),
        F.when(found, best["metadata"]["url"]).otherwise(F.col("url")).alias("url"),
        content.alias("content"),
        metadata.alias("metadata"),
        F.when(invalid, "invalid").when(cached, "cached").when(found, best["mode"]).otherwise("failed").alias("mode"),
        F.when(found, non_empty(best["selector"])).alias("selector_matched"),
        error.alias("error"),
    )
    success = F.col("error").isNull()
    return chosen.withColumns({
        "title": F.when(success, F.col("metadata.title")).otherwise(""),
        "content_length": F.octet_length("content").cast("long"),
        "success": success,
    }).select(*RESULT_COLUMNS)


def fetch_saved(frontier: DataFrame, saved: Sequence[tuple[Callable[[DataFrame], DataFrame], DataFrame]], store: DataFrame,
                as_of: datetime | Column, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """``(results, store with the new content written back)`` of a frontier, from saved pages of several methods.

    ``saved`` are ``(candidates function, pages)`` in the order they are to be tried.  Only keys decide what is read:
    URLs that are invalid or in the store leave first, pages are joined with the URLs still wanted before they are
    parsed, and a method only sees what the ones before it left without a valid answer.
    """
    asked = frontier.select(F.col(url).alias("url")).distinct()
    wanted = cache_misses(asked.where(url_error("url").isNull()), store, as_of)
    found = None
    for candidates_of, pages in saved:
        wanted = checkpointed(wanted)
        near = pages.join(broadcast_if_small(wanted), "url", "left_semi")
        candidates = checkpointed(candidates_of(near))
        found = candidates if found is None else found.unionByName(candidates)
        wanted = wanted.join(candidates.where(candidate_is_valid()).select("url"), "url", "left_anti")
    results = checkpointed(fetch_results(frontier, found, store, as_of, url))
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    writes = results.where(F.col("success") & (F.col("mode") != "cached")).select(
        F.col("request_url").alias("url"), "content", "metadata", moment.alias("created_at"))
    return results, upsert_latest(store, writes)


def batch_fetch(requests: DataFrame, results: DataFrame, batch_id: str = "batch_id", urls: str = "urls",
                max_urls: int | None = None) -> DataFrame:
    """Answer batches from results: input order and duplicates kept; adds ``json`` per batch.

    A batch is one request and one answer; those over ``max_urls``, if given, are refused whole.
    """
    items = batch_items(requests.select(batch_id, urls), urls, max_urls)
    answers = results.select("request_url", batch_item_json(results).alias("_json"))
    answered = (
        items.join(answers, items["url"].eqNullSafe(answers["request_url"]), "left")
        .groupBy(batch_id)
        .agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("_json", F.lit("null")).alias("json"))))
             .alias("_items"))
        .select(batch_id, F.transform("_items", lambda item: item["json"]).alias("items"))
    )
    whole = (
        requests.select(batch_id, (F.lit(False) if max_urls is None else F.size(urls) > max_urls).alias("too_large"))
        .join(answered, batch_id, "left")
        .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    )
    return to_batch_envelope(whole)
