"""Ranking of the results of many requests at once: signals, weights, links, clusters, blending and votes.

All windows are by request, whose results are a short list; one shuffle by request serves them. Only the average linkage
of clusters leaves the JVM, for the head of each request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions import urls as U
from ..operators import dedup as D
from ..operators import ranking as R
from ..operators import search as S
from ..operators import signals as G
from ..schema import SearchPrefs
from ..scratch import Scratch

C = F.col
#: Rows of a request that links and clusters look at; requests with more rows than GATE are clustered and blended. Fixed values.
HEAD, GATE = 50, 5


def weights_of(prefs: SearchPrefs, intent: str) -> dict[str, float]:
    return R.weights(intent, prefs.underground_bias, prefs.freshness_bias, prefs.deseo_mode, prefs.forums_priority)


def scored(results: DataFrame, trust: DataFrame, weights: dict[str, float], query: Column, as_of: Column, by: str = "query_id") -> DataFrame:
    """Results (by, pos, url, domain, title, snippet, content, publish_date, author, source) with their six signals, content
    type and `final`, all rounded to three places, and without their contents."""
    text = F.coalesce(F.when(T.safe(C("content")) != "", C("content")), T.safe(C("snippet")))
    w = W.partitionBy(by, "domain")
    low = W.partitionBy(by, F.lower(T.safe(C("domain"))))
    rows = results.withColumn("_text", text).withColumns({
        "info_density": G.info_density(C("_text")),
        "commercial": G.commercial_bias(C("content"), C("domain"), C("snippet"), C("title"), C("url")),
        "ai_spam": G.ai_spam(C("title"), C("_text")),
        "freshness": G.freshness(G.parsed_date(C("publish_date")), as_of),
        "cluster": G.content_type(C("url"), C("_text"), C("domain"), C("author")),
        "_fp": D.fingerprint(C("_text")),
        "_over": R.over_optimised(C("title"), query),
    }).drop("_text", "content")
    rows = rows.withColumns({
        "diversity": G.steps(F.count("*").over(w), G.DIVERSITY),
        "_rarity": G.steps(F.count("*").over(low), G.RARITY),
        "_cross": F.when(F.size(F.collect_set(F.coalesce("source", F.lit(""))).over(low)) >= 2, 0.12).otherwise(0.0),
        "_again": R.repeats(C("_fp"), (by,)),
    })
    rows = rows.withColumn("obscurity", G.obscurity(C("domain"), C("url"), C("_rarity"), C("_cross")))
    rows = rows.join(trust.select("domain", C("trust").alias("_trust")), "domain", "left")
    penalty = C("_over") + F.when(C("_again"), 0.10).otherwise(0.0) - R.trust_shift(C("_trust"))
    rows = rows.withColumn("final", F.round(R.linear_score(weights, penalty), 3))
    return rows.withColumns({k: F.round(k, 3) for k in R.SIGNALS}).drop("_fp", "_over", "_rarity", "_cross", "_again", "_trust")


def reordered(rows: DataFrame, trust: DataFrame, votes: DataFrame, by: str = "query_id") -> DataFrame:
    """Scored rows (by, pos, url, domain, title, snippet, final, is_exploration, outbound_links) in their final order `rank`:
    link boost of the head, round robin over its clusters, domain cap and exploration, votes."""
    scratch = Scratch(rows.sparkSession, "rank")  # rows are read for links, for clusters and at the end
    n = F.count("*").over(W.partitionBy(by))
    rows = scratch.keep(rows, "scored")
    rows = R.ranked(rows.withColumn("_n", n).withColumn("is_exploration", F.coalesce("is_exploration", F.lit(False))), (by,), name="_first")
    boost = S.inbound_of_head(rows.filter(C("_first") <= HEAD).select(by, "domain", "outbound_links"), trust, by).select(by, "domain", C("boost").alias("_boost"))
    rows = rows.join(boost, [by, "domain"], "left")
    rows = rows.withColumn("trust_boost", F.when(C("_first") <= HEAD, F.coalesce("_boost", F.lit(0.0)))).withColumn("final", F.when(C("trust_boost") > 0, F.round(F.least(F.lit(1.0), C("final") + C("trust_boost")), 3)).otherwise(C("final")))
    head = C("_first") <= HEAD
    rows = rows.withColumn("_second", F.row_number().over(W.partitionBy(by).orderBy(~head, F.when(head, -C("final")), "_first")))
    rows = scratch.keep(rows, "boosted")
    of_head = rows.filter((C("_second") <= HEAD) & (C("_n") > GATE)).select(by, "pos", C("_second").alias("rank"), "url", "title", "snippet", "final")
    rows = rows.join(S.cluster_results(of_head, by), [by, "pos"], "left")
    rows = R.round_robin_order(rows, by, "cluster_id", "_second")
    rows = rows.withColumn("_third", F.when(C("_n") > GATE, C("place")).otherwise(C("_second")))
    rows = R.blend(rows, by, rank="_third", name="_blended").withColumn("_fourth", F.when(C("_n") > GATE, C("_blended")).otherwise(C("_third")))
    rows = R.vote_order(rows, votes.select("url", "votes"), "url", by, "_fourth", "rank")
    return rows.withColumnRenamed("votes", "feedback_vote").drop("_n", "_first", "_second", "_third", "_fourth", "_blended", "_boost", "place", "member")


def rank_results(results: DataFrame, trust: DataFrame, votes: DataFrame, prefs: SearchPrefs, intent: str, as_of: Column, by: str = "query_id") -> DataFrame:
    """The whole ranking of each request; one row a result, `rank` from 1."""
    return reordered(scored(results, trust, weights_of(prefs, intent), F.lit(prefs.query), as_of, by), trust, votes, by)


def filtered(rows: DataFrame, prefs: SearchPrefs) -> DataFrame:
    """Hard filters: domains that hold no corporate name; forums by domain or by a part of domain or URL; more than 800 words.
    Parts are broad on purpose ("ask", "post")."""
    d, u = T.safe(C("domain")), T.safe(C("url"))
    if prefs.exclude_corporate:
        rows = rows.filter(~U.any_of(d, L.CORPORATE))
    if prefs.forums_only:
        rows = rows.filter(d.isin(*L.FORUM_HOSTS) | U.any_of(d, L.FORUM_PARTS) | U.any_of(u, L.FORUM_PARTS))
    if prefs.long_form_only:
        rows = rows.filter(F.coalesce("word_count", F.lit(0)) > 800)
    return rows


def shown(rows: DataFrame) -> DataFrame:
    """What a result's card shows beside its scores."""
    percent = F.round(C("final") * 100)
    return rows.withColumns({
        "score_band": F.when(percent >= 65, "high").when(percent >= 40, "medium").otherwise("low"),
        "is_high_obscurity": C("obscurity") >= 0.70,
        "is_high_spam": C("ai_spam") >= 0.50,
        "independence": 1 - C("commercial"),
        "humanity": 1 - C("ai_spam"),
        "is_live": ~F.coalesce("from_cache", F.lit(False)),
    })
