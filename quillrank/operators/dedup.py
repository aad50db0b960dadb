"""De-duplication: URL key, title similarity, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicons import TITLE_STOPWORDS
from ..scratch import Scratch


def first_of(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """One row a key, the first by position: an aggregation (pre-aggregated before its shuffle) and a semi join."""
    least = df.groupBy(key).agg(F.min(pos).alias(pos))
    return df.join(least, [key, pos], "left_semi")


def title_tokens(t: Column) -> Column:
    clean = F.regexp_replace(F.lower(T.safe(t)), "[^a-z0-9 ]", "")
    return F.array_distinct(F.filter(F.split(clean, " +"), lambda w: (w != "") & ~T.is_in(w, TITLE_STOPWORDS)))


def fingerprint(c: Column, least: int = 60, most: int = 300) -> Column:
    """Of the first 300 lower-cased words of a text with 60 words or more, else null."""
    head = T.first_words(T.lowered(T.safe(c)), most)
    return T.let(head, lambda w: F.when(F.size(w) >= least, F.left(F.md5(F.array_join(w, " ")), F.lit(16))))


def title_pairs(df: DataFrame, tokens: str = "tokens", pos: str = "pos", least: float = 0.75, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a, b), a < b, of one set `by` with title Jaccard >= least: prefix filter over tokens in order of rarity, then verification."""
    rows = df.select(*by, pos, tokens, F.size(tokens).alias("n")).filter("n > 0")
    each = rows.select(*by, pos, "n", F.explode(tokens).alias("t"))
    df_ = each.groupBy(*by, "t").agg(F.count("*").alias("df"))
    prefix = (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int")
    # two sets at or above the threshold share one of their rarest n - ceil(least * n) + 1 tokens
    order = each.join(df_, [*by, "t"]).withColumn("r", F.row_number().over(W.partitionBy(*by, pos).orderBy("df", "t"))).filter(F.col("r") <= prefix)
    keys = order.select(*by, F.col(pos).alias("p"), "t", F.col("n").alias("m"))
    pairs = keys.alias("x").join(keys.alias("y"), [*by, "t"]).filter("x.p < y.p and least(x.m, y.m) >= %s * greatest(x.m, y.m)" % least).select(*by, F.col("x.p").alias("a"), F.col("y.p").alias("b")).distinct()
    a, b = (rows.select(*by, F.col(pos).alias(k), F.col(tokens).alias(f"t{k}")) for k in "ab")
    return pairs.join(a, [*by, "a"]).join(b, [*by, "b"]).withColumn("similarity", T.jaccard(F.col("ta"), F.col("tb"))).filter(F.col("similarity") >= least).select(*by, "a", "b", "similarity")


def dedup_exact(df: DataFrame, by: str, least: float = 0.75) -> DataFrame:
    """The greedy rule inside each set `by`, in order of the unique `pos`: a row goes if a kept row has its key or a similar title.

    Rows of equal titles are one node of the similarity links, so copies make no pairs. In each round the undecided rows
    without an earlier undecided row of their key or of a similar title are kept, and what they exclude goes.
    """
    scratch = Scratch(df.sparkSession, "dedup")
    rows = scratch.keep(df.select(by, "pos", "url_key", F.sort_array(F.array_distinct("tokens")).alias("title")), "rows")
    titles = scratch.keep(rows.filter(F.size("title") > 0).groupBy(by, "title").agg(F.min("pos").alias("head")), "titles")
    pairs = scratch.keep(title_pairs(titles, "title", "head", least, (by,)).select(by, "a", "b"), "pairs")
    own = titles.select(by, F.col("head").alias("a"), F.col("head").alias("b"))
    links = scratch.keep(pairs.unionByName(pairs.select(by, F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(own).toDF(by, "head", "like"), "links")
    undecided = scratch.keep(rows.join(titles, [by, "title"], "left").select(by, "pos", "url_key", "head"), "undecided0")
    kept, r = undecided.select(by, "pos").limit(0), 0
    while not undecided.isEmpty():
        first = undecided.groupBy(by, F.col("head").alias("like")).agg(F.min("pos").alias("m"))
        near = links.join(first, [by, "like"]).groupBy(by, "head").agg(F.min("m").alias("near"))
        same = undecided.groupBy(by, "url_key").agg(F.min("pos").alias("same"))
        seen = undecided.join(near, [by, "head"], "left").join(same, [by, "url_key"], "left")
        now = scratch.keep(seen.filter("pos <= coalesce(near, pos) and pos <= coalesce(same, pos)").select(by, "pos", "url_key", "head"), f"kept{r}")
        gone = links.join(now.select(by, F.col("head").alias("like")), [by, "like"], "left_semi").select(by, "head")
        rest = undecided.join(now.select(by, "pos"), [by, "pos"], "left_anti").join(now.select(by, "url_key"), [by, "url_key"], "left_anti").join(gone, [by, "head"], "left_anti")
        undecided = scratch.keep(rest, f"undecided{r + 1}")
        scratch.drop(f"undecided{r}")
        kept = kept.unionByName(now.select(by, "pos")) if r else now.select(by, "pos")
        r += 1
    return kept
