"""URL expressions: host, registered domain, dedup key, link quality, resolution (Column -> Column)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .text import clamp

#: Suffixes of two labels under which names are registered; fixed values.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br")
SKIP = "(?i)(" + "|".join(L.SKIPPED_LINKS) + ")"
CONTENT = "(" + "|".join(L.CONTENT_WORDS) + ")"
#: Scores of path depths 0, 1, 2 and 3, 4 and 5, and deeper; fixed values.
DEPTHS = (0.20, 0.50, 0.90, 0.70, 0.40)


def text_of(url: Column) -> Column:
    return F.coalesce(url, F.lit(""))


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(text_of(url), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def host(url: Column) -> Column:
    """One canonical host everywhere: lower-cased, without user, port and a leading www."""
    return F.regexp_replace(F.regexp_replace(authority(url), "^.*@|:[0-9]*$", ""), "^www\\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(text_of(url), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def base(url: Column) -> Column:
    return F.regexp_extract(text_of(url), "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def suffix_labels(h: Column) -> Column:
    """How many labels the public suffix of a host has; 0 for one label or an address."""
    parts = F.split(h, "\\.")
    two = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".")
    return F.when((F.size(parts) < 2) | h.rlike("^[0-9.]+$"), 0).when((F.size(parts) > 2) & two.isin(*TWO_LABEL_SUFFIXES), 2).otherwise(1)


def registered_domain(h: Column) -> Column:
    parts = F.split(h, "\\.")
    n = suffix_labels(h) + 1
    return F.when(suffix_labels(h) == 0, h).otherwise(F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), "."))


def core_label(h: Column) -> Column:
    """The registered name without its suffix."""
    return F.split(registered_domain(h), "\\.")[0]


def subdomain(h: Column) -> Column:
    """What stands before the registered domain, '' if nothing does."""
    r = registered_domain(h)
    return F.when(F.length(h) > F.length(r), F.substring(h, F.lit(1), F.length(h) - F.length(r) - 1)).otherwise("")


def dedup_key(url: Column) -> Column:
    """Lower-cased, without scheme, www., parameters, fragment and trailing slash; the query stays."""
    k = F.regexp_replace(F.lower(F.trim(text_of(url))), "#.*$", "")
    k = F.regexp_replace(F.regexp_replace(k, "^[a-z][a-z0-9+.-]*://", ""), "^www\\.", "")
    return F.regexp_replace(F.regexp_replace(k, ";[^/?]*(\\?|$)", "$1"), "/+(\\?|$)", "$1")


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(text_of(url), "#.*$", "")


def segments(p: Column) -> Column:
    return F.filter(F.split(p, "/"), lambda s: s != "")


def depth_score(p: Column) -> Column:
    n = F.size(segments(p))
    return F.when(n == 0, DEPTHS[0]).when(n == 1, DEPTHS[1]).when(n <= 3, DEPTHS[2]).when(n <= 5, DEPTHS[3]).otherwise(DEPTHS[4])


def slug_score(p: Column) -> Column:
    """Root .30; a number or hexadecimal id .10; else five words of three letters make .70, a content word in the path .30."""
    slug = F.coalesce(F.regexp_extract(p, "([^/]+)/*$", 1), F.lit(""))
    words = F.least(F.regexp_count(slug, F.lit("[^-_.]{3,}")) / F.lit(5.0), F.lit(1.0)) * 0.7
    content = F.when(F.lower(p).rlike(CONTENT), 0.3).otherwise(0.0)
    return F.when(slug == "", 0.3).when(slug.rlike("^([0-9-]+|[a-f0-9-]{8,})$"), 0.1).otherwise(F.least(words + content, F.lit(1.0)))


def tld_score(netloc: Column) -> Column:
    """Of a lower-cased authority. Fixed values."""
    return F.when(netloc.rlike("\\.edu$|\\.ac\\.uk$|\\.edu\\."), 1.0).when(netloc.rlike("\\.(gov|mil)$"), 0.90).when(netloc.endswith(".org"), 0.75).when(netloc.endswith(".net"), 0.65).when(netloc.endswith(".com"), 0.55).otherwise(0.60)


def skipped(url: Column) -> Column:
    u = text_of(url)
    return ~u.rlike("^https?://") | u.rlike(SKIP)


def link_quality(url: Column) -> Column:
    """0 if skipped, else .20 depth + .35 slug + .10 date + .15 suffix + .20."""
    p = path(url)
    dated = F.when(p.rlike("/[0-9]{4}/"), 0.10).otherwise(0.0)
    return F.when(skipped(url), 0.0).otherwise(clamp(0.20 * depth_score(p) + 0.35 * slug_score(p) + dated + 0.15 * tld_score(authority(url)) + 0.20))


def link_score(url: Column) -> Column:
    """link_quality to three places."""
    return F.round(link_quality(url), 3)


def without_dots(p: Column) -> Column:
    """A path with its . and .. segments resolved."""
    parts = F.slice(F.split(p, "/"), 2, 10_000)
    step = lambda out, s: F.when(s == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(s == ".", out).otherwise(F.concat(out, F.array(s)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    folder = p.rlike("/\\.{1,2}$")
    return F.when(p.rlike("/\\.{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder & (F.size(kept) > 0), "/").otherwise(""))).otherwise(p)


def resolve(page: Column, href: Column) -> Column:
    """An absolute URL of a link on a page."""
    origin = F.regexp_extract(page, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(path(page), "^(.*/)", 1)
    scheme = F.regexp_extract(page, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    rest = F.regexp_extract(href, "^[^?#]*(.*)$", 1)
    bare = F.regexp_extract(href, "^([^?#]*)", 1)
    there = F.when(bare.startswith("/"), bare).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), bare))
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href == "", without_fragment(page))
        .when(href.startswith("#"), F.concat(without_fragment(page), href))
        .when(href.startswith("?"), F.concat(origin, path(page), href))
        .otherwise(F.concat(origin, without_dots(there), rest))
    )


def unwrapped(href: Column, parameter: str = "uddg") -> Column:
    """The target of a redirect link that carries it in a parameter, else the link itself."""
    inner = F.regexp_extract(text_of(href), f"[?&]{parameter}=([^&#]*)", 1)
    return F.when(inner != "", F.coalesce(F.try_url_decode(inner), inner)).otherwise(href)


def any_of(c: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(x) for x in parts])
