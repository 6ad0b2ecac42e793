"""Column expressions for URLs.  All of them stay inside Spark's own functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostweave.functions import fixed

BLANKS = " \t\n\r\f\x0b"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def any_of(words: list[str]) -> str:
    """Regex alternation of literal words."""
    return "|".join(re.escape(w) for w in words)


def tidy(url: Column) -> Column:
    """Trim, and drop the tabs and line breaks a URL may not contain."""
    return F.translate(F.btrim(url, F.lit(BLANKS)), "\t\r\n", "")


def absolute(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, url).otherwise(F.concat(F.lit("https://"), url))


def bare_host(netloc: Column) -> Column:
    """Lower-case host without leading dots and without a ``www.`` prefix."""
    return F.regexp_replace(F.ltrim(F.lower(netloc), F.lit(".")), r"^www\.", "")


def host_of(url: Column) -> Column:
    return bare_host(F.regexp_extract(absolute(url), _SCHEME + r"([^/?#]*)", 1))


def raw_path_of(url: Column) -> Column:
    """Path as written, without the ``;params`` of its last segment."""
    path = F.regexp_extract(absolute(url), _SCHEME + r"[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(path, r";[^/]*$", "")


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def path_of(url: Column) -> Column:
    """Canonical path: at least ``/``, single slashes, no trailing slash."""
    single = F.regexp_replace(raw_path_of(url), r"/{2,}", "/")
    cut = F.rtrim(single, F.lit("/"))
    return F.when(cut == "", F.lit("/")).otherwise(cut)


def clean_query(query: Column) -> Column:
    """Query string without empty items and tracking parameters.

    One replace over ``&a=1&b=2`` instead of split/filter/join keeps the whole
    clean-up inside generated code.
    """
    names = "|".join(fixed.TRACKING_NAMES)
    tracking = rf"(?i)&(?:{fixed.TRACKING_PREFIX}[^&]*|(?:{names})(?:=[^&]*)?)(?=&|$)"
    kept = F.regexp_replace(F.concat(F.lit("&"), query), tracking, "")
    return F.btrim(F.regexp_replace(kept, r"&{2,}", "&"), F.lit("&"))


def canonical_url(url: Column) -> Column:
    query = clean_query(query_of(absolute(url)))
    return F.concat(
        F.lit("https://"), host_of(url), path_of(url),
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )


def percent_decode(text: Column, plus_is_space: bool = True) -> Column:
    """Decode ``%xx``; a stray ``%`` stays as it is instead of failing the job."""
    safe = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    if not plus_is_space:
        safe = F.regexp_replace(safe, r"\+", "%2B")
    return F.url_decode(safe)


def query_param(url: Column, name: str) -> Column:
    """First non-empty value of a query parameter, decoded; ``''`` if absent."""
    return percent_decode(F.regexp_extract(query_of(url), rf"(?:^|&){name}=([^&]+)", 1))


def unwrap_redirect(href: Column) -> Column:
    """Target of a search engine's redirect link, else the link itself."""
    uddg = percent_decode(query_param(href, "uddg"), plus_is_space=False)
    q, u = query_param(href, "q"), query_param(href, "url")
    target = F.when(q != "", q).otherwise(u)
    return (
        F.when(href.contains("duckduckgo.com/l/") & (uddg != ""), uddg)
        .when(
            (href.startswith("https://www.google.com/url?") | href.startswith("/url?"))
            & target.startswith("http"),
            target,
        )
        .otherwise(href)
    )


def excluded_tld(host: Column) -> Column:
    """Excluded label last, or second to last of three or more labels."""
    labels = "|".join(fixed.EXCLUDED_TLD_LABELS)
    return F.btrim(host, F.lit(".")).rlike(rf"\.({labels})(\.[^.]+)?$")


def noise_host(host: Column, match: str = "substring", hosts: list[str] | None = None) -> Column:
    """``substring`` matches anywhere in the host; ``label`` only whole labels."""
    hosts = hosts or fixed.NOISE_HOSTS
    if match == "substring":
        return host.rlike(any_of(hosts))
    if match == "label":
        ends = "|".join(re.escape(h) + ("" if h.endswith(".") else "$") for h in hosts)
        return host.rlike(rf"(?:^|\.)(?:{ends})")
    raise ValueError(f"unknown match mode {match!r}")


def quote_plus(text: Column) -> Column:
    """Form encoding that keeps ``~`` and escapes ``*``."""
    return F.replace(
        F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )
