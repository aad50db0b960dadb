"""A search from sources to payload, votes, statistics and maintenance: the API of the engine as Python functions.

The store is a folder of Parquet tables with the schemas of `schema.TABLES`, or any DataFrames of these shapes; sources
are functions (query) -> DataFrame of records. "Crawling" reads landed pages.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..operators import budget as B
from ..operators import crawl as X
from ..operators import dedup as D
from ..operators import search as S
from ..operators import store as K
from ..schema import SearchPrefs
from ..sources.tables import archive_fallback, union_sources
from . import ranking as P

C = F.col
#: Local pages that a search adds, results whose pages are read, fixed values.
LOCAL, READ = 15, 15
#: Sources by name; a source takes (spark, query) and returns records. More can be registered.
SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


@dataclass
class Store:
    """The engine's tables; those that aren't given are empty."""

    spark: SparkSession
    pages: DataFrame = None
    domains: DataFrame = None
    queries: DataFrame = None
    votes: DataFrame = None
    landed: DataFrame = None
    archive: DataFrame = None
    added: dict = field(default_factory=dict)

    def __post_init__(self):
        for name, kind in schema.TABLES.items():
            now = getattr(self, name)
            setattr(self, name, schema.empty(self.spark, kind) if now is None else schema.conformed(now, kind))
        if self.landed is None:
            self.landed = schema.empty(self.spark, "url string, html string")
        if self.archive is None:
            self.archive = schema.empty(self.spark, "url string, content string, word_count int, author string, publish_date string")

    def trust(self, as_of: Column) -> DataFrame:
        known = self.domains.filter(C("page_count") >= 2)
        return known.select("domain", F.round(K.decayed_trust(C("avg_score"), C("last_seen"), as_of), 4).alias("trust"))


@dataclass
class SearchResponse:
    """results: rows in order of `rank`, at most max_results. metrics: the other entries of the payload."""

    results: DataFrame
    metrics: dict


def read_pages(rows: DataFrame, landed: DataFrame, most: int = READ, links: bool = False) -> DataFrame:
    """Content, words and, where asked for, outbound links of the first `most` rows from the landed pages behind them; other
    rows stay as they are."""
    by = "query_id"
    html = landed.select("url", "html").dropDuplicates(["url"])
    j = rows.join(html.select("url", C("html").alias("_html")), "url", "left").withColumn("_read", (C("pos") < most) & C("_html").isNotNull())
    text = H.plain_text(C("_html"))
    j = j.withColumn("content", F.when(C("_read"), text).otherwise(C("content"))).withColumn("word_count", F.when(C("_read"), T.word_count(C("content"))).otherwise(C("word_count")))
    if not links:
        return j.drop("_html", "_read", "outbound_links").withColumn("outbound_links", F.lit(None).cast("array<string>"))
    found = X.outbound_links(j.filter("_read").select(by, "pos", "url", C("_html").alias("html")), by, "pos")
    found = found.groupBy(by, "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "link"))), lambda x: x["link"]).alias("_links"))
    return j.drop("_html", "_read").join(found, [by, "pos"], "left").withColumn("outbound_links", F.coalesce("_links", "outbound_links")).drop("_links")


def deduplicated(rows: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The greedy rule by URL and title in order of pos, which is counted anew from 0 inside each request."""
    keyed = rows.withColumn("url_key", U.dedup_key(C("url"))).withColumn("tokens", D.title_tokens(C("title")))
    kept = D.dedup_exact(keyed.select("query_id", "pos", "url_key", "tokens"), "query_id", threshold)
    left = rows.join(kept, ["query_id", "pos"], "left_semi")
    return left.withColumn("pos", (F.row_number().over(W.partitionBy("query_id").orderBy("pos")) - 1).cast("long"))


def numbered(*frames: DataFrame) -> DataFrame:
    """Records of several sources as results of one request, in the order of the sources."""
    rows = union_sources(*frames)
    rows = rows.withColumn("query_id", F.lit(0).cast("long"))
    # one request's results are a short list
    rows = rows.withColumn("pos", (F.row_number().over(W.partitionBy("query_id").orderBy("src_order", "pos")) - 1).cast("long"))
    return schema.conformed(rows, schema.RESULT)


def search(spark: SparkSession, store: Store, prefs: SearchPrefs, as_of: Column | None = None, sources: dict | None = None) -> SearchResponse:
    """The best results for a request, and what the payload says about them; the store's new rows are in store.added."""
    as_of = F.current_timestamp() if as_of is None else as_of
    intent, extra = spark.range(1).select(S.intent(F.lit(prefs.query)).alias("i"), S.extra_variants(F.lit(prefs.query)).alias("v")).first()
    trust = store.trust(as_of) if prefs.use_cache else schema.empty(spark, "domain string, trust double")
    frames, cache_hits = [], 0
    if prefs.use_cache:
        found = K.as_results(store.pages).withColumn("score", F.lit(0.0))
        hits = S.search_pages(found, prefs.query, LOCAL).withColumn("pos", C("place") - 1).drop("score")
        cache_hits = hits.count()
        frames.append(hits)
    for name, source in (SOURCES if sources is None else sources).items():
        asked = [prefs.query, *extra] if name == "ddg" else [prefs.query]
        if name == "reddit" and not (prefs.forums_priority or prefs.forums_only):
            continue
        frames += [source(spark, q) for q in asked]
    rows = numbered(*frames) if frames else schema.empty(spark, schema.RESULT)
    if rows.isEmpty():
        return SearchResponse(rows, {"query": prefs.query, "total": 0, "error": "No results from any source."})
    crawling = prefs.deep_crawl or prefs.seed_expand or prefs.domain_explore
    rows = read_pages(deduplicated(rows), store.landed, links=prefs.seed_expand or prefs.domain_explore)
    rows = archive_fallback(rows, store.archive, "url")
    none = schema.empty(spark, "url string, votes long")
    more, counts = [], {"deep_crawl_pages": 0, "seed_expanded_pages": 0, "domain_explored_pages": 0}
    if crawling:
        prelim = P.rank_results(rows, trust, none, prefs, intent, as_of)
        prelim = prelim.select("query_id", "rank", "pos", "url", "domain", "final", "outbound_links")
        left = B.pools(X.TOTAL, intent)[0]
        if prefs.deep_crawl:
            found = X.deeper(prelim, store.landed, trust, intent=intent)
            more.append(found)
            counts["deep_crawl_pages"] = found.count()
            left -= counts["deep_crawl_pages"]
        if prefs.seed_expand:
            found = X.expand_seeds(rows, store.landed, trust, intent=intent, pool=max(0, left))
            more.append(found)
            counts["seed_expanded_pages"] = found.count()
            left -= counts["seed_expanded_pages"]
        if prefs.domain_explore:
            best = K.explorable(store.domains, as_of)
            found = X.explore_domains(prelim, store.landed, trust, best, intent=intent, pool=max(0, left))
            more.append(found)
            counts["domain_explored_pages"] = found.count()
    if more:
        rows = numbered(rows, *[m.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy("url"))) for m in more])
        rows = deduplicated(rows)
    votes = K.votes_of(store.votes, rows)
    ranked = P.rank_results(rows, trust, votes, prefs, intent, as_of)
    kept = P.filtered(ranked, prefs)
    kept = kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    contents = rows.select("query_id", "pos", "content")
    store.added["pages"] = K.stored(kept.join(contents, ["query_id", "pos"]), prefs.query, as_of) if prefs.use_cache else None
    store.added["queries"] = spark.range(1).select(F.lit(prefs.query).alias("query"), F.lit(intent).alias("intent"), as_of.alias("ts"))
    return SearchResponse(P.shown(kept).filter(C("rank") <= prefs.max_results).orderBy("rank"), payload(kept, rows, trust, store, prefs, intent, extra, cache_hits, counts, crawling))


def payload(kept: DataFrame, rows: DataFrame, trust: DataFrame, store: Store, prefs: SearchPrefs, intent: str, extra: list[str], cache_hits: int, counts: dict, crawling: bool) -> dict:
    """One request's metrics: sums over its short list."""
    bands = kept.join(trust, "domain", "left").agg(F.count("*").alias("n"), F.count_if("is_exploration").alias("x"), *[F.count_if(K.trust_band(C("trust")) == b).alias(b) for b in ("high", "medium", "low")]).first()
    sources = {r[0]: r[1] for r in rows.groupBy(F.coalesce("source", F.lit("unknown")).alias("s")).count().collect()}  # a row a source
    probes = kept.filter("is_exploration").select("domain").distinct().count() if crawling else 0
    trust_pool, explore_pool = B.pools(X.TOTAL, intent)
    used = sum(counts.values())
    return {
        "query": prefs.query, "total": bands["n"], "intent": intent, "exploration_used": min(probes, explore_pool), "exploration_results_count": bands["x"],
        "trust_distribution": {b: bands[b] for b in ("high", "medium", "low")}, "sources_used": sources, **counts, "cache_hits": cache_hits,
        "saved_pages_total": store.pages.count() if prefs.use_cache else 0, "query_variants": len(extra),
        "crawl_budget": {"budget_total": X.TOTAL, "trust_pool": trust_pool, "explore_pool_total": explore_pool, "pages_found": used, "intent": intent} if crawling else None,
        "trusted_domains": trust.count(),
    }


def vote(spark: SparkSession, store: Store, url: str, query: str, feedback: int, as_of: Column | None = None) -> dict:
    """Record a vote of +1 or -1 for a result; the last vote of a query counts."""
    schema.check_vote(url, query, feedback)
    if feedback not in (1, -1):
        return {"ok": False, "error": "feedback must be 1 or -1"}
    return recorded(spark, store, url, query, feedback, as_of)


def retract(spark: SparkSession, store: Store, url: str, query: str, as_of: Column | None = None) -> dict:
    """Take a vote back (and not cast the opposite one)."""
    schema.check_vote(url, query, 0)
    return recorded(spark, store, url, query, 0, as_of)


def recorded(spark: SparkSession, store: Store, url: str, query: str, feedback: int, as_of: Column | None) -> dict:
    at = F.current_timestamp() if as_of is None else as_of
    row = spark.range(1).select(F.lit(url).alias("url"), F.lit(query).alias("query"), F.lit(feedback).alias("feedback"), at.cast("timestamp").alias("ts"))
    store.votes = store.votes.unionByName(row)
    return {"ok": True}


def stats(store: Store) -> dict:
    return K.stats(store.pages, store.domains).first().asDict()


def maintain(store: Store, as_of: Column, most_rows: int) -> dict[str, int]:
    """Expiry and trim of the stored pages; how many went."""
    store.pages, gone = K.maintained(store.pages, as_of, most_rows)
    return gone
