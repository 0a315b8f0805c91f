"""Every method over saved answers, one after the other: a later method only reads what the earlier ones left open.

Saved answers are filed under the address that was requested, not under the page wanted.  A stage computes that address
for the pages still wanted, joins the answers to it, parses what it finds and takes the pages with a valid answer out of
the wanted ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import constants as C
from gleanery.functions.urls import provider_request_url, route_class, url_domain, url_error, url_hash
from gleanery.operators.cascade import candidate_is_valid, plan_for
from gleanery.operators.joins import broadcast_if_small
from gleanery.operators.providers import NORMALIZERS, http_candidates, rendered_candidates, union_candidates
from gleanery.operators.store import PREFIX, cache_misses, delete_keys, prefix_of
from gleanery.plans.fetch import fetch_results
from gleanery.session import as_column, checkpointed, stored_table

REQUEST = "request_url"
CANDIDATES_OF: dict[str, Callable[[DataFrame], DataFrame]] = {
    C.MODE_HTTP: http_candidates, C.MODE_STEALTH: rendered_candidates, **NORMALIZERS,
}
# Methods whose request names the page itself: plain and rendered pages, and the service the page's address is posted to.
_BY_PAGE = (C.MODE_HTTP, C.MODE_STEALTH, C.MODE_FIRECRAWL)


class Stage(NamedTuple):
    """One method: how many pages were wanted of it, the answers it was given to parse, and what came of them."""

    mode: str
    wanted: int
    answers: DataFrame
    candidates: DataFrame


class Fetched(NamedTuple):
    results: DataFrame
    store: DataFrame | None
    stages: list[Stage]


def request_address(mode: str, url: Column | str) -> Column:
    """The address under which a method's answer for ``url`` is filed; empty where the method cannot ask for it."""
    return as_column(url) if mode in _BY_PAGE else provider_request_url(mode, url)


def stage_order(available: Iterable[str] = C.ALL_MODES) -> list[str]:
    """All methods that any route uses, none before one that some route tries earlier."""
    plans = [[mode for _, mode in plan_for(route, available)] for route in C.ROUTE_PLANS]
    waiting = list(dict.fromkeys(mode for plan in plans for mode in plan))
    order: list[str] = []
    while waiting:
        ready = [m for m in waiting if all(set(p[:p.index(m)]) <= set(order) for p in plans if m in p)]
        if not ready:
            raise ValueError(f"the plans disagree about the order of {waiting}")
        order.append(ready[0])
        waiting.remove(ready[0])
    return order


def write_answers(answers: DataFrame, path: str) -> None:
    """Answers in folders by a prefix of the hash of their address, so that a stage lists only the folders it needs."""
    prefixed = answers.withColumn(PREFIX, prefix_of(F.sha2(REQUEST, 256)))
    prefixed.hint("rebalance", F.col(PREFIX)).write.mode("error").partitionBy(PREFIX).parquet(path)


def answers_wanted(mode: str, wanted: DataFrame, answers: DataFrame) -> DataFrame:
    """The saved ``answers`` of one method for the pages ``url`` of ``wanted``, with that ``url``.

    Answers that nobody wants leave before they are parsed; a page for which the method has no address gets a row
    without an answer, for the method to say so.  Pages that share an address each get the answer.
    """
    asked = wanted.select("url", request_address(mode, "url").alias(REQUEST))
    unasked = asked.where(F.col(REQUEST) == "").select("url")
    asked = asked.where(F.col(REQUEST) != "")
    if PREFIX in answers.columns:
        prefixes = asked.select(prefix_of(F.sha2(REQUEST, 256))).distinct().collect()  # at most 256
        answers = answers.where(F.col(PREFIX).isin([p[0] for p in prefixes])).drop(PREFIX)
    payload = answers.drop("url") if mode not in _BY_PAGE or REQUEST in answers.columns else answers.withColumnRenamed("url", REQUEST)
    near = payload.join(broadcast_if_small(asked), REQUEST).drop(REQUEST)
    return near if mode in _BY_PAGE else near.unionByName(unasked, allowMissingColumns=True)


def fetch_staged(
    frontier: DataFrame, answers: Mapping[str, DataFrame], store: DataFrame | None = None,
    as_of: datetime | Column | None = None, url: str = "url", available: Iterable[str] | None = None,
    force_stealth: bool = False,
) -> Fetched:
    """One result per distinct URL, as of :func:`gleanery.plans.fetch.fetch_results` over all answers parsed.

    ``answers`` has a table for each method that has any: ``request_url`` (or ``url``) with ``html`` for pages as they were
    sent or rendered (``content_type`` and ``error`` where known), with ``body`` and ``status`` for a service.  Methods
    are tried in the order of each URL's route; URLs that are invalid or in the store are never looked for.  With a
    store its new version is returned as well.  ``available`` are the configured methods, all with answers by default.
    """
    available = tuple(available if available is not None else (m for m in C.ALL_MODES if m in answers))
    asked = frontier.select(F.col(url).alias("url")).distinct().where(url_error("url").isNull())
    wanted = asked if store is None else cache_misses(asked, store, as_of)
    wanted = checkpointed(wanted.withColumn("route", route_class(url_domain("url"), force_stealth, C.MODE_STEALTH in available)))
    stages: list[Stage] = []
    for mode in stage_order(available):
        routes = [route for route in C.ROUTE_PLANS if mode in C.ROUTE_PLANS[route]]
        open_ = wanted.where(F.col("route").isin(routes))
        n = open_.count()
        if mode not in answers or not n:
            continue
        near = answers_wanted(mode, open_, answers[mode])
        candidates = stored_table(union_candidates(CANDIDATES_OF[mode](near)), f"stage-{mode}")
        stages.append(Stage(mode, n, near, candidates))
        done = candidates.where(candidate_is_valid()).select("url")
        wanted = checkpointed(wanted.join(broadcast_if_small(done), "url", "left_anti"))
    spark = frontier.sparkSession
    found = [s.candidates for s in stages] or [union_candidates(CANDIDATES_OF[C.MODE_JINA](
        spark.createDataFrame([], "url string, body string")))]
    results = fetch_results(frontier, union_candidates(*found), store, as_of, url, available, force_stealth)
    if store is None:
        return Fetched(results, None, stages)
    results = stored_table(results, "stage-results")
    return Fetched(results, written_back(results, store, as_of), stages)


def written_back(results: DataFrame, store: DataFrame, as_of: datetime | Column) -> DataFrame:
    """The store with the new results of a run.

    A URL is only fetched when the store has no fresh entry of it, so its result replaces whatever there is; results are
    one for each URL and no content is compared or shuffled.
    """
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    found = results.where(F.col("success") & (F.col("mode") != "cached") & (F.col("content") != ""))
    new = found.select(url_hash("request_url").alias("url_hash"), F.col("request_url").alias("url"), "content", "metadata", moment.alias("created_at"))
    return delete_keys(store, found, "request_url").select(*new.columns).unionByName(new)
