"""URL functions.  All are plain Catalyst expressions, so filters on them stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery import constants as C
from gleanery.functions.text import trim_space
from gleanery.session import as_column

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*:"
_AUTHORITY = rf"^(?:{_SCHEME})?//"
_NOT_HEX = r"%(?![0-9A-Fa-f]{2})[\s\S]{0,2}"
_HOST_NOT_HEX = rf"{_NOT_HEX}|%(?!25)[0-7][0-9A-Fa-f]"
_CONTROL = r"^[^#]*[\x00-\x1F\x7F]"
# The everyday shape of a URL; anything that matches needs no closer look.
_PLAIN = r"^(?i:https?)://[A-Za-z0-9._~-]+(?::[0-9]*)?(?:[/?#][^%\x00-\x1F\x7F]*)?\z"
# Host of a well-formed URL: in brackets, or before a port, or on its own.
_USER_CHAR = r"[A-Za-z0-9\-._:~!$&'()*+,;=%@]"
_HOST_CHAR = r"[^/?#@ \\^`{|}\[\x00-\x1F\x7F"
_HOST = (
    rf"{_AUTHORITY}(?:{_USER_CHAR}*@)?"
    r"(\[[^/?#]*\](?=(?::[0-9]*)?(?:[/?#]|\z))"
    rf"|{_HOST_CHAR}]*(?=:[0-9]*(?:[/?#]|\z))"
    rf"|{_HOST_CHAR}:]*(?=[/?#]|\z))"
)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable: evaluated once, and the rules on it stay out of generated code.

    For the rules on odd URLs, which few rows reach; the everyday ones are decided by one regular expression before.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parse_problem(url: Column) -> Column:
    """Why a URL cannot be parsed, or null."""
    # Without brackets only what follows the last colon of the host has to be a port.
    host_port = F.regexp_extract(url, rf"{_AUTHORITY}(?:[^/?#]*@)?([^/?#]*)", 1)
    path_escape = F.regexp_extract(url, rf"^(?:{_SCHEME}(?=/))?(?://[^/?#]*)?[^?#]*?({_NOT_HEX})", 1)
    opaque = url.rlike(rf"^{_SCHEME}(?!/)")
    user = F.regexp_extract(url, rf"{_AUTHORITY}([^/?#]*)@", 1)

    def escape_problem(found: Column) -> Column:
        return F.concat(F.lit('invalid URL escape "'), found, F.lit('"'))

    def host_problem(host: Column) -> Column:
        port = F.when(host.startswith("["), F.regexp_extract(host, r"\]([^\]]*)\z", 1)).otherwise(
            F.regexp_extract(host, r":[^:]*\z", 0))
        char = F.regexp_extract(host, r"[ \\^`{|}]", 0)
        return (
            F.when(host.startswith("[") & ~host.contains("]"), "missing ']' in host")
            .when(~port.rlike(r"^(?::[0-9]*)?\z"), F.concat(F.lit('invalid port "'), port, F.lit('" after host')))
            .when(host.rlike(_HOST_NOT_HEX), escape_problem(F.regexp_extract(host, _HOST_NOT_HEX, 0)))
            .when(char != "", F.concat(F.lit('invalid character "'), F.replace(char, F.lit("\\"), F.lit("\\\\")),
                                       F.lit('" in host name')))
        )

    return (
        F.when(url.rlike(_CONTROL), "net/url: invalid control character in URL")
        .when(url.startswith(":"), "missing protocol scheme")
        .when(url.rlike(rf"^(?!{_SCHEME})[^/?#]*:"), "first path segment in URL cannot contain colon")
        .otherwise(F.coalesce(
            _once(host_port, host_problem),
            F.when(user.rlike(rf"[^{_USER_CHAR[1:]}"), "net/url: invalid userinfo")
            .when(~opaque & (path_escape != ""), escape_problem(path_escape)),
        ))
    )


def _quoted(text: Column) -> Column:
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return F.concat(F.lit('"'), text, F.lit('"'))


def _refusal(url: Column) -> Column:
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    return _once(_parse_problem(url), lambda problem: (
        F.when(problem.isNotNull(),
               F.concat(F.lit(C.MSG_URL_FORMAT + "parse "), _quoted(F.substring_index(url, "#", 1)), F.lit(": "),
                        problem))
        .when(~scheme.isin("http", "https"),
              F.concat(F.lit(C.MSG_URL_SCHEME[0]), scheme, F.lit(C.MSG_URL_SCHEME[1])))
        .when(~url.rlike(rf"{_AUTHORITY}(?:[^/?#]*@)?[^/?#]"), C.MSG_URL_NO_HOST)
    ))


def url_error(url: Column | str) -> Column:
    """Why a URL is refused, or null when it is acceptable.  White space around it is ignored."""
    raw = F.coalesce(as_column(url), F.lit(""))
    return (
        F.when(raw.rlike(_PLAIN), F.lit(None).cast("string"))
        .when(raw == "", C.MSG_URL_EMPTY)
        .otherwise(_once(trim_space(raw), _refusal))
    )


def _odd_domain(url: Column) -> Column:
    broken = url.rlike(rf"{_CONTROL}|^[^?#]*%(?![0-9A-Fa-f]{{2}})")
    return _once(F.regexp_extract(url, _HOST, 1), lambda host: (
        F.when(broken | host.rlike(r"%(?!25)[0-7]"), "")
        .when(host.startswith("["), F.regexp_replace(host, r"^\[|\]$", ""))
        .when(host.contains("%"), F.coalesce(F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B"))), F.lit("")))
        .otherwise(host)
    ))


def url_domain(url: Column | str) -> Column:
    """Host without port, user and brackets, case kept; empty when the URL cannot be parsed."""
    raw = F.coalesce(as_column(url), F.lit(""))
    return (
        F.when(raw.rlike(_PLAIN), F.regexp_extract(raw, r"^[A-Za-z]+://([A-Za-z0-9._~-]+)", 1))
        .otherwise(_once(raw, _odd_domain))
    )


def url_hash(url: Column | str) -> Column:
    """Store key: the first 16 hex digits of the SHA-256 of the URL."""
    return F.substring(F.sha2(as_column(url), 256), 1, C.HASH_HEX_DIGITS)


def _belongs_to(domain: Column, owners: Iterable[str]) -> Column:
    """The domain is one of ``owners`` or below one."""
    names = "|".join(re.escape(owner) for owner in owners)
    return domain.rlike(rf"(?:^|\.)(?:{names})\z")


def is_twitter(domain: Column | str) -> Column:
    return _belongs_to(as_column(domain), C.TWITTER_DOMAINS)


def is_stealth(domain: Column | str, has_browser: bool = True) -> Column:
    """Hosts known to need a rendered page; never true without a browser."""
    return _belongs_to(as_column(domain), C.STEALTH_DOMAINS) if has_browser else F.lit(False)


def route_class(domain: Column | str, force_stealth: Column | bool = False, has_browser: bool = True) -> Column:
    """``twitter``, ``stealth`` or ``normal``."""
    domain = as_column(domain)
    forced = F.lit(force_stealth) if isinstance(force_stealth, bool) else force_stealth
    stealth = (forced | is_stealth(domain)) if has_browser else F.lit(False)
    return F.when(is_twitter(domain), "twitter").when(stealth, "stealth").otherwise("normal")


def tweet_api_url(url: Column | str) -> Column:
    """Address under which the saved answer for a tweet link is filed; empty for any other link."""
    hosts = "|".join(re.escape(host) for host in C.TWEET_LINK_HOSTS)
    link = trim_space(url)
    pattern = rf"(?s)^https://(?:{hosts})/([^?]*)"
    return F.when(
        link.rlike(pattern), F.concat(F.lit(C.SERVICE_URLS[C.MODE_FXTWITTER] + "/"), F.regexp_extract(link, pattern, 1))
    ).otherwise("")


def query_escape(text: Column | str) -> Column:
    """Escape for a query string: letters, digits and ``-_.~`` stay, a space becomes ``+``."""
    encoded = F.url_encode(as_column(text))
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def provider_request_url(mode: str, url: Column | str) -> Column:
    """Address under which a service's saved answer for ``url`` is filed."""
    url = as_column(url)
    service = C.SERVICE_URLS.get(mode)
    if mode in (C.MODE_JINA, C.MODE_DEFUDDLE, C.MODE_MARKDOWN_NEW):
        return F.concat(F.lit(service + "/"), url)
    if mode == C.MODE_WEBPAGESNAP:
        return F.concat(F.lit(service + "?url="), url)
    if mode == C.MODE_BRAVE:
        return F.concat(F.lit(service + "?q="), query_escape(url), F.lit(f"&count={C.SEARCH_RESULT_COUNT}"))
    if mode == C.MODE_FXTWITTER:
        return tweet_api_url(url)
    if mode == C.MODE_FIRECRAWL:
        return F.lit(service)
    raise ValueError(f"mode {mode!r} has no service address")
