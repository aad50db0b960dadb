"""Records of search sources from responses that were landed as they came: result pages (HTML) and JSON.

There is no live network: a connector lands (query_id, body) rows, and these functions turn them into result records of
one shape. A response that can't be read gives no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U

C = F.col
RECORD = ("title", "url", "snippet", "domain", "source", "content", "word_count", "publish_date", "author")
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def plain(markup: Column) -> Column:
    """Text of a piece of markup."""
    t = F.regexp_replace(T.safe(markup), "(?s)<[^>]*>", "")
    for entity, sign in _ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return T.stripped(t)


def record(url: Column, title: Column, snippet: Column, source: str, publish_date: Column | None = None) -> list[Column]:
    """The base record: domain by the public suffix, no content yet."""
    null = F.lit(None).cast("string")
    return [title.alias("title"), url.alias("url"), snippet.alias("snippet"), U.registered_domain(U.host(url)).alias("domain"), F.lit(source).alias("source"), null.alias("content"), F.lit(0).alias("word_count"), (null if publish_date is None else publish_date.cast("string")).alias("publish_date"), null.alias("author")]


def result_pages(landed: DataFrame, by: str = "query_id", most: int = 15) -> DataFrame:
    """Results of landed HTML result pages (by, body): anchors of class result__a with the snippet of their block, redirects
    unwrapped, links to the source itself left out, the first `most`."""
    block = F.regexp_extract_all(T.safe(C("body")), F.lit('(?s)(<a[^>]*class="[^"]*result__a[^"]*".*?)(?=<a[^>]*class="[^"]*result__a[^"]*"|\\z)'), F.lit(1))
    each = landed.select(by, F.posexplode(block).alias("pos", "part"))
    href = F.replace(F.regexp_extract("part", '^<a[^>]*href="([^"]*)"', 1), F.lit("&amp;"), F.lit("&"))
    rows = each.select(by, "pos", U.unwrapped(href).alias("_url"), plain(F.regexp_extract("part", "(?s)^<a[^>]*>(.*?)</a>", 1)).alias("_title"), plain(F.regexp_extract("part", '(?s)class="[^"]*result__snippet[^"]*"[^>]*>(.*?)</(?:a|div|span)>', 1)).alias("_snippet"))
    rows = rows.filter(C("_url").startswith("http") & ~C("_url").contains("duckduckgo.com"))
    rows = rows.groupBy(by).agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "_url", "_title", "_snippet"))), 1, most).alias("r")).select(by, F.posexplode("r").alias("pos", "r"))
    return rows.select(by, "pos", *record(C("r._url"), C("r._title"), C("r._snippet"), "ddg"))


API = "struct<web: struct<results: array<struct<url: string, title: string, description: string, age: string>>>>"


def api_results(landed: DataFrame, by: str = "query_id", most: int = 15) -> DataFrame:
    """Results of landed JSON responses of a web search API (by, body); the relative age is the publish date."""
    found = F.slice(F.from_json(C("body"), API)["web"]["results"], 1, min(most, 20))
    rows = landed.select(by, F.posexplode(found).alias("pos", "r"))
    return rows.select(by, "pos", *record(F.coalesce("r.url", F.lit("")), F.coalesce("r.title", F.lit("")), F.coalesce("r.description", F.lit("")), "brave", C("r.age")))


THREADS = "struct<data: struct<children: array<struct<data: struct<permalink: string, subreddit_name_prefixed: string, title: string, selftext: string, score: int, id: string, author: string>>>>>"


def thread_results(landed: DataFrame, by: str = "query_id", most: int = 10) -> DataFrame:
    """Results of landed JSON listings of forum threads (by, body), with score and id; removed texts are no content."""
    rows = landed.select(by, F.posexplode(F.slice(F.from_json(C("body"), THREADS)["data"]["children"], 1, most)).alias("pos", "c")).filter("c.data is not null").select(by, "pos", "c.data.*")
    text = T.stripped(C("selftext"))
    said = F.when((text != "") & ~text.isin("[deleted]", "[removed]"), text)
    title = F.concat(F.lit("["), F.coalesce("subreddit_name_prefixed", F.lit("r/?")), F.lit("] "), T.safe(C("title")))
    snippet = F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 200), F.lit("…"))).when(text != "", text).otherwise(T.safe(C("title")))
    return rows.select(
        by, "pos", title.alias("title"), F.concat(F.lit("https://www.reddit.com"), T.safe(C("permalink"))).alias("url"), snippet.alias("snippet"), F.lit("reddit.com").alias("domain"), F.lit("reddit").alias("source"),
        said.alias("content"), F.coalesce(T.word_count(said), F.lit(0)).alias("word_count"), F.lit(None).cast("string").alias("publish_date"), "author", F.coalesce("score", F.lit(0)).alias("reddit_score"), C("id").alias("reddit_id"),
    )


def with_comments(threads: DataFrame, comments: DataFrame, key: str = "reddit_id") -> DataFrame:
    """Threads with their best comments (key, pos, body, score) below their text: of the first five those that are not
    removed and have a score above 2, three at most; words are counted anew."""
    first = comments.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "body", "score"))), 1, 5).alias("c"))
    good = F.filter("c", lambda x: (T.stripped(x["body"]) != "") & ~T.stripped(x["body"]).isin("[deleted]", "[removed]") & (x["score"] > 2))
    top = first.select(key, F.slice(F.transform(good, lambda x: T.stripped(x["body"])), 1, 3).alias("_top"))
    j = threads.join(top, key, "left").withColumn("_said", F.size(F.coalesce("_top", F.array().cast("array<string>"))) > 0)
    full = T.stripped(F.concat(T.safe(C("content")), F.lit("\n\n"), F.array_join("_top", "\n\n")))
    j = j.withColumn("content", F.when(C("_said"), full).otherwise(C("content")))
    return j.withColumn("word_count", F.when(C("_said"), T.word_count(C("content"))).otherwise(C("word_count"))).drop("_top", "_said")
