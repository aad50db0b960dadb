"""Crawling as joins with landed pages: links of pages, their quality, and what a budget lets in.

Requests are rows of `by`; a request's results are a bounded list, so windows by request are small. Landed pages are
(url, html); a link is fetched by a join on its URL without fragment. Pages that were not landed are not found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import lexicons as L
from ..functions import text as T
from ..functions import urls as U
from . import budget as B

C = F.col
#: Pages of a request over all crawlers. Fixed values, as are the limits below.
TOTAL = 25


def links_of(pages: DataFrame, *keep: str) -> DataFrame:
    """(keep, url, at, link) of pages (keep, url, html): absolute links in page order."""
    found = pages.select(*keep, "url", F.posexplode(H.hrefs(C("html"))).alias("at", "href")).withColumn("href", F.trim("href"))
    return found.filter("href <> ''").select(*keep, "url", "at", U.resolve(C("url"), C("href")).alias("link"), C("href").startswith("#").alias("inner"))


def first_links(links: DataFrame, most: int, *keep: str) -> DataFrame:
    """Of each page its distinct links in order, `most` at most."""
    own = links.groupBy(*keep, "url", "link").agg(F.min("at").alias("at"))
    return own.withColumn("nth", F.row_number().over(W.partitionBy(*keep, "url").orderBy("at"))).filter(C("nth") <= most)


def internal_links(pages: DataFrame, *keep: str, most: int = 20) -> DataFrame:
    """(keep, url, link, nth): links to pages of the same site that may have content: no chrome, no files, not the root, not
    the page itself; told apart without their fragments."""
    links = links_of(pages, *keep).filter(~C("inner"))
    path = F.lower(U.path(C("link")))
    good = (U.authority(C("link")) == U.authority(C("url"))) & C("link").rlike("^https?://") & ~path.rlike("(?i)" + L.SITE_CHROME) & ~path.rlike("(?i)" + L.SITE_FILES) & (F.size(U.segments(path)) >= 1)
    links = links.filter(good).withColumn("link", U.without_fragment(C("link"))).filter(C("link") != U.without_fragment(C("url")))
    return first_links(links, most, *keep)


def site_links(pages: DataFrame, *keep: str, most: int = 80) -> DataFrame:
    """(keep, url, link, nth): all links to the same domain in page order, as the domain explorer takes them; no distinct."""
    links = links_of(pages, *keep).filter(~C("inner") & (U.host(C("link")) == U.host(C("url"))))
    return links.withColumn("nth", F.row_number().over(W.partitionBy(*keep, "url").orderBy("at"))).filter(C("nth") <= most)


def outbound_links(pages: DataFrame, *keep: str, most: int = 60) -> DataFrame:
    """(keep, url, link, nth): distinct links to other hosts that are not skipped, the first `most` of each page."""
    links = links_of(pages, *keep).filter(~C("inner") & C("link").rlike("^https?://") & (U.host(C("link")) != U.host(C("url"))) & ~U.skipped(C("link")))
    return first_links(links, most, *keep)


def scored_links(links: DataFrame, least: float = 0.30, own: str | None = None) -> DataFrame:
    """Distinct links with their quality, those below `least` and, where `own` names a column, those to that domain left out."""
    out = links.withColumn("link", F.trim("link")).filter(~U.skipped(C("link"))).withColumn("score", U.link_score(C("link"))).filter(C("score") >= least)
    out = out.withColumn("domain", U.host(C("link")))
    return out.filter(C("domain") != C(own)) if own else out


def fetched(links: DataFrame, landed: DataFrame, least_words: int, source: str, snippet: int = 300) -> DataFrame:
    """Links joined with the landed pages behind them, as results with text, title and words."""
    known = landed.select(U.without_fragment(C("url")).alias("_key"), "html").dropDuplicates(["_key"])
    j = links.withColumn("_key", U.without_fragment(C("link"))).join(known, "_key").drop("_key")
    j = j.withColumn("content", H.plain_text(C("html"))).withColumn("word_count", T.word_count(C("content"))).filter(C("word_count") >= least_words)
    title = F.substring(H.title(C("html"), F.regexp_extract("link", "([^/]*)$", 1)), 1, 512)
    return j.withColumn("title", title).withColumn("snippet", F.substring("content", 1, snippet)).withColumn("source", F.lit(source)).drop("html")


def deeper(ranked: DataFrame, landed: DataFrame, trust: DataFrame, by: str = "query_id", intent: str = "informational", seeds: int = 5, of_first: int = 7, each: int = 3, most: int = 12) -> DataFrame:
    """One level below the best results (by, rank, url, domain): the most trusted of the first rows get pages of the trust
    pool; of each seed's internal links the first landed ones with 100 words are found, 12 a request at most."""
    pool, _ = B.pools(TOTAL, intent)
    head = ranked.filter(C("rank") <= min(of_first, 2 * seeds)).join(trust, "domain", "left")
    head = head.withColumn("turn", F.row_number().over(W.partitionBy(by).orderBy(*B.by_trust(head, "rank"))))
    wanted = head.select(by, "domain", "url", C("turn").alias("pos"), F.lit(each).cast("long").alias("want"), B.depth_limit(C("trust"), intent).cast("long").alias("limit"))
    granted = B.allocate(wanted, by, pool).filter("granted > 0")
    granted = granted.withColumn("nth_seed", F.row_number().over(W.partitionBy(by).orderBy("pos"))).filter(C("nth_seed") <= seeds)
    html = landed.select("url", "html").dropDuplicates(["url"])
    links = internal_links(granted.join(html, "url").select(by, "nth_seed", "granted", "url", "html"), by, "nth_seed", "granted")
    found = fetched(links, landed, 100, "crawled")
    found = found.withColumn("_n", F.row_number().over(W.partitionBy(by, "nth_seed").orderBy("nth"))).filter(C("_n") <= C("granted"))
    found = found.withColumn("_m", F.row_number().over(W.partitionBy(by).orderBy("nth_seed", "nth"))).filter(C("_m") <= most)
    short = F.concat(F.array_join(T.first_words(C("content"), 40), " "), F.lit("…"))
    return found.select(by, C("link").alias("url"), U.registered_domain(U.host(C("link"))).alias("domain"), "title", short.alias("snippet"), "content", "word_count", "source", C("url").alias("discovered_via"), F.lit(False).alias("is_exploration"), C("_m").alias("place"))


def seed_candidates(results: DataFrame, trust: DataFrame, by: str = "query_id", intent: str = "informational", least: float = 0.40, most: int = 60) -> DataFrame:
    """Links (by, link, domain, score, priority, place) of results (by, pos, url, domain, outbound_links) to domains that the
    results don't have: the first 40 links of each result, the best 60 by quality, in order of priority."""
    links = results.select(by, "pos", F.posexplode(F.slice("outbound_links", 1, 40)).alias("at", "link"))
    links = links.groupBy(by, F.trim("link").alias("link")).agg(F.min(F.struct("pos", "at")).alias("first"))
    scored = scored_links(links, least)
    have = results.select(by, U.host(C("url")).alias("domain")).distinct()
    fresh = scored.join(have, [by, "domain"], "left_anti")
    fresh = fresh.withColumn("nth", F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), "first"))).filter(C("nth") <= most)
    fresh = fresh.join(trust, "domain", "left").withColumn("priority", B.multiplied(C("trust"), C("score"))).withColumn("limit", B.depth_limit(C("trust"), intent).cast("long"))
    return fresh.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(F.desc("priority"), "nth")))


def explored_links(results: DataFrame, trust: DataFrame, by: str, most: int, seed: str, pool: int) -> DataFrame:
    """Links to unknown or little trusted domains that the exploration pool pays for."""
    links = results.select(by, F.explode("outbound_links").alias("url")).distinct().withColumn("domain", U.host(C("url")))
    probes = B.unknown_domains(links, trust, by, most, seed).withColumn("pos", C("turn"))
    return B.allocate_exploration(probes, by, pool).filter("granted > 0")


def expand_seeds(results: DataFrame, landed: DataFrame, trust: DataFrame, by: str = "query_id", intent: str = "informational", pool: int | None = None, seed: str = "0") -> DataFrame:
    """Pages behind links of the results, one a new domain, as far as the trust pool goes; and up to three probes of unknown
    or little trusted domains from the exploration pool, marked as exploration."""
    trusted, explore = B.pools(TOTAL, intent)
    candidates = seed_candidates(results, trust, by, intent)
    one = candidates.withColumn("_r", F.row_number().over(W.partitionBy(by, "domain").orderBy("place"))).filter("_r = 1").drop("_r")
    wants = one.select(by, "domain", "link", C("place").alias("pos"), F.lit(1).cast("long").alias("want"), "limit")
    granted = B.allocate(wants, by, trusted if pool is None else pool).filter("granted > 0").select(by, "link", "domain", F.lit(False).alias("is_exploration"))
    known = results.select(by, C("url").alias("link")).distinct()
    probes = explored_links(results, trust, by, 3, seed, explore).select(by, C("url").alias("link"), "domain", F.lit(True).alias("is_exploration"))
    probes = probes.join(known, [by, "link"], "left_anti").join(granted.select(by, "domain"), [by, "domain"], "left_anti")
    found = fetched(granted.unionByName(probes), landed, 100, "seed_expanded")
    return found.select(by, C("link").alias("url"), "domain", "title", "snippet", "content", "word_count", "source", F.lit("seed_expand").alias("discovered_via"), "is_exploration")


def best_seeds(ranked: DataFrame, by: str = "query_id", least: float = 0.60) -> DataFrame:
    """Of each domain of a request its first result with a score of `least` or more."""
    good = ranked.filter(C("final") >= least).withColumn("domain", U.host(C("url"))).filter("domain <> ''")
    return good.withColumn("_r", F.row_number().over(W.partitionBy(by, "domain").orderBy("rank"))).filter("_r = 1").select(by, "domain", "url", C("rank").alias("pos"))


def site_pages(seeds: DataFrame, landed: DataFrame, known: DataFrame, by: str) -> DataFrame:
    """Of each seed (by, domain, url, granted, is_exploration) the best landed internal pages that aren't known."""
    html = landed.select("url", "html").dropDuplicates(["url"])
    links = site_links(seeds.join(html, "url").select(by, "domain", "granted", "is_exploration", "url", "html"), by, "domain", "granted", "is_exploration", most=1 << 30)
    links = links.join(known.select(by, C("url").alias("link")), [by, "link"], "left_anti")
    links = links.withColumn("nth", F.row_number().over(W.partitionBy(by, "url").orderBy("at"))).filter(C("nth") <= 80)
    keep = [by, "domain", "granted", "is_exploration"]
    links = scored_links(links.withColumnRenamed("domain", "_site").filter(C("link") != C("url")), 0.35).drop("domain").withColumnRenamed("_site", "domain")
    links = links.groupBy(*keep, "url", "link", "score").agg(F.min("nth").alias("nth"))
    best = links.withColumn("_r", F.row_number().over(W.partitionBy(by, "url").orderBy(F.desc("score"), "nth"))).filter(C("_r") <= C("granted"))
    found = fetched(best, landed, 120, "domain_explored")
    return found.select(by, C("link").alias("url"), "domain", "title", "snippet", "content", "word_count", "source", F.concat(F.lit("domain_explore:"), C("domain")).alias("discovered_via"), "is_exploration")


def explore_domains(ranked: DataFrame, landed: DataFrame, trust: DataFrame, explorable: DataFrame, by: str = "query_id", intent: str = "informational", sites: int = 3, each: int = 5, pool: int | None = None, seed: str = "1") -> DataFrame:
    """Internal pages of the three most trusted domains among the well-scored results and the stored explorable domains (whose
    seed is their root), and of up to four unknown or little trusted domains that results link to."""
    trusted, explore = B.pools(TOTAL, intent)
    seeds = best_seeds(ranked, by)
    asked = ranked.select(by).distinct()
    stored = asked.crossJoin(F.broadcast(explorable.limit(2 * sites).select("domain")))  # six rows at most
    stored = stored.join(seeds.select(by, "domain"), [by, "domain"], "left_anti").select(by, "domain", F.concat(F.lit("https://"), "domain", F.lit("/")).alias("url"), F.lit(1 << 30).cast("int").alias("pos"))
    every = seeds.unionByName(stored).join(trust, "domain", "left")
    every = every.withColumn("turn", F.row_number().over(W.partitionBy(by).orderBy(F.desc(F.coalesce("trust", F.lit(0.5))), "pos", "domain"))).filter(C("turn") <= sites)
    wants = every.select(by, "domain", "url", C("turn").alias("pos"), F.lit(each).cast("long").alias("want"), B.depth_limit(C("trust"), intent).cast("long").alias("limit"))
    granted = B.allocate(wants, by, trusted if pool is None else pool).filter("granted > 0").select(by, "domain", "url", "granted", F.lit(False).alias("is_exploration"))
    known = ranked.select(by, "url")
    probes = explored_links(ranked, trust, by, 4, seed, explore).join(known, [by, "url"], "left_anti").select(by, "domain", "url", F.lit(1).cast("long").alias("granted"), F.lit(True).alias("is_exploration"))
    return site_pages(granted.unionByName(probes), landed, known, by)
