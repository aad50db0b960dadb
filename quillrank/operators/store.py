"""The page store and its memories: gates, upsert, tags, expiry, trust, votes, query log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: Rows that one trim takes away, characters of a page that are indexed, seconds between two maintenance runs. Fixed values.
TRIM, INDEXED, INTERVAL = 500, 8000, 3600


def gate(df: DataFrame, words: int = 80, final: float = 0.60, spam: float = 0.65, commercial: float = 0.75) -> DataFrame:
    return df.filter((F.coalesce("url", F.lit("")) != "") & (F.col("word_count") >= words) & (F.col("final") >= final) & ~(F.col("ai_spam") > spam) & ~(F.col("commercial") > commercial))


def truncated(c: Column, most: int = 3000) -> Column:
    w = T.words(c)
    return F.when(F.size(w) > most, F.array_join(F.slice(w, 1, most), " ")).otherwise(c)


def upsert(store: DataFrame, new: DataFrame, key: str, updated: list[str]) -> DataFrame:
    """Rows of new replace `updated` columns of rows with their key, other columns stay; unknown keys are added."""
    n = new.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in store.columns if c != key])
    j = store.join(n, store[key] == n["_k"], "full_outer")
    is_new = F.col("_k").isNotNull()
    pick = lambda c: F.when(is_new & (store[key].isNull() | F.lit(c in updated)), F.col(f"_{c}")).otherwise(store[c])
    return j.select(*[F.coalesce(store[key], F.col("_k")).alias(c) if c == key else pick(c).alias(c) for c in store.columns])


def add_tag(tags: Column, tag: Column, most: int = 20) -> Column:
    return F.slice(F.array_union(tags, F.array(tag)), 1, most)


def expires_after(score: Column) -> Column:
    return F.when(score >= 0.85, 30).when(score >= 0.70, 7).otherwise(3)


def alive(df: DataFrame, as_of: Column, score: str = "score", at: str = "cached_at") -> DataFrame:
    return df.filter(F.col(at) >= as_of - F.make_dt_interval(expires_after(F.col(score))))


def trimmed(df: DataFrame, key: str, drop: int = 500, score: str = "score", at: str = "cached_at") -> DataFrame:
    """Without the `drop` lowest rows by (score, age): a distributed top-k and an anti join."""
    low = df.orderBy(score, at, key).limit(drop).select(key)
    return df.join(low, key, "left_anti")


def domain_means(df: DataFrame, domain: str, score: str, at: str) -> DataFrame:
    return df.groupBy(domain).agg(F.count("*").alias("page_count"), F.avg(score).alias("avg_score"), F.max(at).alias("last_seen"))


def decayed_trust(avg: Column, last_seen: Column, as_of: Column) -> Column:
    days = (F.unix_timestamp(as_of) - F.unix_timestamp(last_seen)) / 86400
    pull = F.when(last_seen.isNull() | (days < 7), 0.0).when(days < 30, 0.15).when(days < 90, 0.40).otherwise(0.65)
    return avg + (0.5 - avg) * pull


def latest(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Last write wins; ties by the larger value."""
    return df.groupBy(*keys).agg(F.max(F.struct(at, value)).alias("l")).select(*keys, F.col(f"l.{value}").alias(value))


def query_memory(log: DataFrame) -> DataFrame:
    """query, intent, ts -> one row a normalised query; the first spelling and the last intent stay."""
    h = F.left(F.sha2(F.lower(F.trim("query")), 256), F.lit(32))
    return log.withColumn("query_hash", h).groupBy("query_hash").agg(F.min(F.struct("ts", "query"))["query"].alias("query"), F.max(F.struct("ts", "intent"))["intent"].alias("intent"), F.count("*").alias("search_count"), F.max("ts").alias("last_searched"))


def trust_band(trust: Column) -> Column:
    t = F.coalesce(trust, F.lit(0.5))
    return F.when(t >= 0.75, "high").when(t >= 0.55, "medium").otherwise("low")


def indexed_text(title: Column, content: Column) -> Column:
    """What the full-text index holds of a page."""
    return F.substring(F.concat(T.safe(title), F.lit(" "), T.safe(content)), 1, INDEXED)


def as_results(pages: DataFrame) -> DataFrame:
    """Stored pages as results: their source is the cache."""
    return pages.select("url", "domain", "title", "snippet", "content", "word_count", "publish_date", "author", F.lit("cache").alias("source"), "cluster", F.lit(True).alias("from_cache"), "cached_at")


def stored(results: DataFrame, query: str, as_of: Column) -> DataFrame:
    """Results that pass the gate, as rows of the store; contents and not only snippets are kept."""
    r = gate(results)
    return r.select("url", "domain", F.substring("title", 1, 512).alias("title"), F.substring("snippet", 1, 512).alias("snippet"), truncated(F.coalesce(F.nullif("content", F.lit("")), F.col("snippet"))).alias("content"), "word_count", F.col("final").alias("score"), "publish_date", "author", F.coalesce("source", F.lit("cache")).alias("source"), "cluster", as_of.alias("cached_at"), F.when(F.lit(query) != "", F.array(F.lit(query))).otherwise(F.array().cast("array<string>")).alias("query_tags"))


#: Columns that storing a known page writes anew.
UPDATED = ["title", "snippet", "content", "word_count", "score", "cluster", "cached_at"]


def store_pages(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store after a batch: known pages get new contents and one tag more, up to 20; others are added. The last row of a
    URL counts."""
    last = new.withColumn("_r", F.row_number().over(W.partitionBy("url").orderBy(F.desc("score"), "title"))).filter("_r = 1").drop("_r")
    tags = last.select(F.col("url").alias("_u"), F.col("query_tags").alias("_tags"))
    merged = upsert(store, last, "url", UPDATED).join(tags, F.col("url") == F.col("_u"), "left")
    return merged.withColumn("query_tags", F.slice(F.array_union(F.coalesce("query_tags", "_tags"), F.coalesce("_tags", F.array().cast("array<string>"))), 1, 20)).drop("_u", "_tags")


def domain_pages(pages: DataFrame, domain: str, limit: int) -> DataFrame:
    return pages.filter(F.col("domain") == domain).orderBy(F.desc("score"), F.desc("cached_at"), "url").limit(limit)


def explorable(domains: DataFrame, as_of: Column, least: float = 0.60, days: int = 3, limit: int = 6) -> DataFrame:
    """The best domains (domain, avg_score, last_explored) that were never explored or not for some days."""
    old = F.col("last_explored").isNull() | (F.col("last_explored") < as_of - F.make_dt_interval(F.lit(days)))
    return domains.filter((F.col("avg_score") >= least) & old).orderBy(F.desc("avg_score"), "domain").limit(limit)


def mark_explored(domains: DataFrame, visits: DataFrame) -> DataFrame:
    """Domains after visits (domain, pages_added, at); pages found so are counted apart from those whose scores make the mean."""
    v = visits.groupBy("domain").agg(F.sum("pages_added").alias("_pages"), F.max("at").alias("_at"), F.count("*").alias("_n"))
    zero = F.lit(0).cast("long")
    return domains.join(v, "domain", "full_outer").select("domain", F.coalesce("page_count", zero).alias("page_count"), "avg_score", "last_seen", F.greatest("last_explored", "_at").alias("last_explored"), (F.coalesce("explored_pages", zero) + F.coalesce("_pages", zero)).alias("explored_pages"), (F.coalesce("exploration_count", zero) + F.coalesce("_n", zero)).alias("exploration_count"))


def stats(pages: DataFrame, domains: DataFrame) -> DataFrame:
    """One row: pages, domains, oldest page, mean score, pages of high value."""
    p = pages.agg(F.count("*").alias("total_pages"), F.min("cached_at").alias("oldest_cached"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 3).alias("avg_score"), F.count_if(F.col("score") >= 0.85).alias("high_value_pages"))
    return p.crossJoin(domains.agg(F.count("*").alias("total_domains")))  # one row by one row


def maintained(pages: DataFrame, as_of: Column, most_rows: int, drop: int = TRIM, key: str = "url") -> tuple[DataFrame, dict[str, int]]:
    """Expiry, then a trim if more than `most_rows` rows are left; the pages that stay and how many went by either."""
    total = pages.count()
    kept = alive(pages, as_of)
    left = kept.count()
    if left <= most_rows:
        return kept, {"expired": total - left, "trimmed": 0}
    return trimmed(kept, key, drop), {"expired": total - left, "trimmed": min(drop, left)}


def due(last_run: float, now: float, interval: float = INTERVAL) -> bool:
    """Whether maintenance may run again."""
    return now - last_run > interval


def vote_key(c: Column) -> Column:
    return F.left(F.sha2(F.lower(F.trim(c)), 256), F.lit(32))


def valid_votes(votes: DataFrame, value: str = "feedback") -> DataFrame:
    """Votes (url, query, feedback, ts) of +1 or -1 by their hashes; a vote of 0 takes back an earlier one and is kept as such."""
    return votes.filter(F.col(value).isin(1, -1, 0)).select(vote_key(F.col("url")).alias("url_hash"), vote_key(F.col("query")).alias("query_hash"), F.col(value).cast("int").alias("feedback"), "ts")


def votes_of(votes: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, votes): the sum of the last votes of every query, for the given URLs only."""
    known = urls.select("url").distinct().withColumn("url_hash", vote_key(F.col("url")))
    last = latest(valid_votes(votes).join(known.select("url_hash"), "url_hash", "left_semi"), ["url_hash", "query_hash"], "ts", "feedback")
    return last.groupBy("url_hash").agg(F.sum("feedback").alias("votes")).join(known, "url_hash").select("url", "votes")


def votes_by_query(votes: DataFrame) -> DataFrame:
    """(url_hash, by_query): a map of the last vote of each query."""
    last = latest(valid_votes(votes), ["url_hash", "query_hash"], "ts", "feedback").filter("feedback <> 0")
    return last.groupBy("url_hash").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("query_hash", "feedback")))).alias("by_query"))
