"""Choosing one result per URL from a table of candidates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import constants as C
from gleanery.functions.html import is_valid_content, metadata_struct
from gleanery.functions.urls import route_class, url_domain
from gleanery.session import as_column


def plan_for(route: str, available: Iterable[str] = C.ALL_MODES) -> list[tuple[int, str]]:
    """``(priority, mode)`` of a route class, without modes that are not configured."""
    available = set(available)
    return [(i, mode) for i, mode in enumerate(C.ROUTE_PLANS[route], start=1) if mode in available]


def plan_routes(frontier: DataFrame, url: str = "url", available: Iterable[str] = C.ALL_MODES,
                force_stealth: Column | bool = False) -> DataFrame:
    """One row per URL and method to try: adds ``route, priority, mode``."""
    available = tuple(available)
    route = route_class(url_domain(url), force_stealth, C.MODE_STEALTH in available)
    plans = F.lit(None)
    for name in C.ROUTE_PLANS:
        steps = F.array(*[
            F.struct(F.lit(i).alias("priority"), F.lit(mode).alias("mode")) for i, mode in plan_for(name, available)
        ])
        plans = F.when(F.col("route") == name, steps) if name == "normal" else plans.when(F.col("route") == name, steps)
    return (
        frontier.withColumn("route", route)
        .withColumn("_step", F.explode(plans))
        .select(*frontier.columns, "route", "_step.priority", "_step.mode")
    )


def candidate_priority(route: Column, mode: Column, available: Iterable[str] = C.ALL_MODES) -> Column:
    """Position of a candidate's mode in the plan of its URL; null when the plan does not use it."""
    available = tuple(available)
    places = [
        (f"{name}/{planned}", i) for name in C.ROUTE_PLANS for i, planned in plan_for(name, available)
    ]
    literal = F.create_map(*[F.lit(v) for place in places for v in place])
    return F.try_element_at(literal, F.concat(route, F.lit("/"), mode))


def candidate_is_valid() -> Column:
    """No error, and enough content for its kind.  A search result needs no minimum."""
    kind = (
        F.when(F.col("mode") == C.MODE_HTTP, F.col("content_type"))
        .when(F.col("mode") == C.MODE_FXTWITTER, "application/json")
        .otherwise("text/html")
    )
    return F.col("error").isNull() & ((F.col("mode") == C.MODE_BRAVE) | is_valid_content(F.col("content"), kind))


_SHOWN_MODES = sorted({m for parts in C.FAILURE_TEXT.values() for _, m in parts if not m.startswith("=")})


def _route_of(url: str, available: Iterable[str], force_stealth: bool) -> Column:
    return route_class(url_domain(url), force_stealth, C.MODE_STEALTH in available)


def _failure_text(route: Column) -> Column:
    text = F.lit(None).cast("string")
    for name, parts in C.FAILURE_TEXT.items():
        shown = [
            F.concat(
                F.lit(f"{label}="),
                F.lit(source[1:]) if source.startswith("=")
                else F.coalesce(F.col(f"_err_{source}"), F.lit(C.NO_ERROR_TEXT)),
            )
            for label, source in parts
        ]
        text = F.when(route == name, F.concat(F.lit(C.FAILURE_PREFIX), F.concat_ws(", ", *shown))).otherwise(text)
    return text


def weigh_candidates(candidates: DataFrame, available: Iterable[str] = C.ALL_MODES,
                     force_stealth: bool = False) -> DataFrame:
    """One row per URL: the first acceptable candidate in plan order, and the error of each method.

    The aggregation buffers have a fixed size (one candidate and one error text per method) and hold no content that
    was refused, so partial aggregation shrinks a URL with many copies before the shuffle.
    """
    available = tuple(available)
    priority = candidate_priority(_route_of("url", available, force_stealth), F.col("mode"), available)
    ranked = candidates.withColumn("_priority", F.when(candidate_is_valid(), priority))
    accepted = F.col("_priority").isNotNull()
    kept = F.when(accepted, F.struct("mode", "content", "selector", "metadata"))
    # Equal candidates of one method are told apart by what they hold, not by their order.
    order = F.when(accepted, F.struct("_priority", F.xxhash64("content", "selector", F.to_json("metadata"))))
    return ranked.groupBy("url").agg(
        F.min_by(kept, order).alias("_best"),
        *[F.max(F.when(F.col("mode") == m, F.col("error"))).alias(f"_err_{m}") for m in _SHOWN_MODES],
    )


def failure_error(url: str, available: Iterable[str] = C.ALL_MODES, force_stealth: bool = False) -> Column:
    """The error of a URL without an acceptable candidate, on top of :func:`weigh_candidates`."""
    return _failure_text(_route_of(url, tuple(available), force_stealth))


def select_best(candidates: DataFrame, frontier: DataFrame | None = None, url: str = "url",
                available: Iterable[str] = C.ALL_MODES, force_stealth: bool = False) -> DataFrame:
    """The first acceptable candidate per URL in plan order, or a failure row with the errors of all methods.

    URLs of ``frontier`` without any candidate fail as well.
    """
    best = weigh_candidates(candidates, available, force_stealth)
    if frontier is not None:
        best = frontier.select(F.col(url).alias("url")).distinct().join(best, "url", "left")
    found = F.col("_best").isNotNull()
    return best.select(
        F.col("url").alias("request_url"),
        F.when(found, F.col("_best.mode")).otherwise("failed").alias("mode"),
        F.coalesce(F.col("_best.content"), F.lit("")).alias("content"),
        F.coalesce(F.col("_best.selector"), F.lit("")).alias("selector"),
        F.coalesce(F.col("_best.metadata"), metadata_struct(url="url")).alias("metadata"),
        found.alias("success"),
        F.when(~found, failure_error("url", available, force_stealth)).alias("error"),
    )


def resolve_attempts(attempts: DataFrame, keys: Iterable[str], attempt: str = "attempt", error: str = "error",
                     payload: Iterable[str] = (), max_attempts: int | None = None) -> DataFrame:
    """First success, within ``max_attempts`` where that is given, else the last error.

    Of equal attempt numbers one whole row wins, by a hash of what it holds.
    """
    keys, payload = list(keys), list(payload)
    number, failed = F.col(attempt), as_column(error).isNotNull()
    if max_attempts is not None:
        attempts = attempts.where(number <= max_attempts)
    row = F.struct(number.alias("_number"), *payload)
    order = F.struct(number, F.xxhash64(F.to_json(row)))
    result = attempts.groupBy(*keys).agg(
        F.min_by(row, F.when(~failed, order)).alias("_first"),
        F.max(F.when(failed, F.struct(number.alias("number"), F.col(error).alias("error")))).alias("_last"),
    )
    ok = F.col("_first").isNotNull()
    return result.select(
        *keys, ok.alias("ok"), F.col("_first._number").alias("ok_attempt"),
        *[F.col("_first")[p].alias(p) for p in payload], F.when(~ok, F.col("_last.error")).alias("error")
    )


def batch_items(requests: DataFrame, urls: str = "urls", max_urls: int | None = None) -> DataFrame:
    """One row per requested URL with its place ``pos`` (from 0); batches over ``max_urls``, if given, are refused whole."""
    others = [c for c in requests.columns if c != urls]
    accepted = requests if max_urls is None else requests.where(F.size(urls) <= max_urls)
    return accepted.select(*others, F.posexplode(urls).alias("pos", "url"))
