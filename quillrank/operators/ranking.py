"""Weights, linear ranking and re-ranking (windows by request; every order has a tiebreak)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

SIGNALS = ("info_density", "obscurity", "commercial", "freshness", "diversity", "ai_spam")
#: Fixed values.
BASE = {"info_density": 0.26, "obscurity": 0.22, "commercial": 0.20, "freshness": 0.09, "diversity": 0.09, "ai_spam": 0.14}
SHARED = ("info_density", "obscurity", "freshness", "diversity")
#: What moves a weight: (when, weight, factor, what is added, least, most), applied from top to bottom. `when` names a
#: slider, whose distance from 0.5 multiplies what is added, a toggle or an intent. Fixed values.
RULES = (
    ("underground", "obscurity", 1.0, 0.30, 0.05, 9.0),
    ("underground", "info_density", 1.0, -0.195, 0.05, 9.0),
    ("fresh", "freshness", 1.0, 0.15, 0.0, 0.40),
    ("less_seo", "ai_spam", 1.6, 0.0, 0.0, 0.30),
    ("less_seo", "commercial", 1.4, 0.0, 0.0, 0.35),
    ("prefer_forums", "obscurity", 1.0, 0.10, 0.0, 0.55),
    ("freshness_sensitive", "freshness", 1.0, 0.15, 0.0, 0.40),
    ("freshness_sensitive", "obscurity", 1.0, -0.05, 0.05, 9.0),
    ("deep_research", "obscurity", 1.0, 0.08, 0.0, 0.45),
    ("deep_research", "info_density", 1.0, 0.05, 0.0, 0.38),
    ("navigational", "diversity", 1.0, 0.05, 0.0, 0.20),
    ("navigational", "obscurity", 1.0, -0.08, 0.05, 9.0),
)


def weights(intent: str = "informational", underground: float = 0.5, fresh: float = 0.5, less_seo: bool = False, prefer_forums: bool = False) -> dict[str, float]:
    """Weights of the six signals; those in SHARED are scaled to what the other two leave, 0.40 at least."""
    on = {"underground": underground - 0.5, "fresh": fresh - 0.5, "less_seo": float(less_seo), "prefer_forums": float(prefer_forums), intent: 1.0}
    w = dict(BASE)
    for when, name, factor, add, least, most in RULES:
        slider = when in ("underground", "fresh")
        if when in on and (slider or on[when]):
            w[name] = min(most, max(least, w[name] * factor + add * on[when]))
    scale = max(0.40, 1 - w["commercial"] - w["ai_spam"]) / sum(w[k] for k in SHARED)
    return {k: round(v * scale if k in SHARED else v, 4) for k, v in w.items()}


def linear_score(w: dict[str, float], penalty=0.0) -> Column:
    """Commercial bias and spam are taken off; `penalty` too."""
    up = [w[k] * F.col(k) for k in SHARED]
    return T.clamp(up[0] + up[1] + up[2] + up[3] - w["commercial"] * F.col("commercial") - w["ai_spam"] * F.col("ai_spam") - penalty)


def trust_shift(trust: Column) -> Column:
    """What a known domain's trust adds, at most .04 either way."""
    return F.coalesce((trust - 0.5) * 0.08, F.lit(0.0))


def repeats(fp: Column, by: tuple[str, ...], pos: str = "pos") -> Column:
    """Whether an earlier row of the set has the same fingerprint."""
    return fp.isNotNull() & (F.row_number().over(W.partitionBy(*by, fp).orderBy(pos)) > 1)


def ranked(df: DataFrame, by: tuple[str, ...], score: str = "final", pos: str = "pos", name: str = "rank") -> DataFrame:
    """Positions inside each set; `by` names the request, without which all rows would meet in one task."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), pos)))


def domain_cap(df: DataFrame, by: str, top: int = 10, most: int = 2, rank: str = "rank") -> DataFrame:
    """At most `most` rows a domain in each set's top; the greedy rule as two windows."""
    turn = F.row_number().over(W.partitionBy(by, "domain").orderBy(rank))
    slot = F.row_number().over(W.partitionBy(by, F.col("turn") <= most).orderBy(rank))
    return df.withColumn("turn", turn).withColumn("slot", F.when(F.col("turn") <= most, slot)).withColumn("in_top", F.coalesce(F.col("slot") <= top, F.lit(False)))


def round_robin_order(df: DataFrame, by: str, cluster: str, rank: str = "rank", top: int = 10) -> DataFrame:
    """Position `place` of each row of a set after members of its clusters took turns for the first `top` places; the
    clusters come in the order of `cluster`, the rest keeps its order."""
    turn = F.row_number().over(W.partitionBy(by, cluster).orderBy(F.desc("final"), rank))
    first = F.row_number().over(W.partitionBy(by).orderBy(F.col(cluster).isNull(), "_turn", cluster))
    df = df.withColumn("_turn", turn).withColumn("_first", first).withColumn("_in", F.col(cluster).isNotNull() & (F.col("_first") <= top))
    place = F.row_number().over(W.partitionBy(by).orderBy(F.desc("_in"), F.when(F.col("_in"), F.col("_first")).otherwise(F.col(rank))))
    return df.withColumn("place", place).drop("_turn", "_first", "_in")


def round_robin(df: DataFrame, by: str, cluster: str, top: int = 10) -> DataFrame:
    """Members of clusters in turns, best first."""
    df = df.withColumn("turn", F.row_number().over(W.partitionBy(by, cluster).orderBy(F.desc("final"), "pos")))
    return df.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy("turn", cluster))).filter(F.col("place") <= top)


def inject_exploration(df: DataFrame, by: str, least: int = 2, rank: str = "rank") -> DataFrame:
    """The best exploration rows below the top take the place of the worst others in it until `least` are there."""
    have = F.sum((F.col("in_top") & F.col("is_exploration")).cast("int")).over(W.partitionBy(by))
    free = ~F.col("in_top") & F.col("is_exploration")
    weak = F.col("in_top") & ~F.col("is_exploration")
    df = df.withColumn("lack", F.greatest(F.lit(least) - have, F.lit(0)))
    df = df.withColumn("n_free", F.sum(free.cast("int")).over(W.partitionBy(by))).withColumn("n_weak", F.sum(weak.cast("int")).over(W.partitionBy(by)))
    swaps = F.least("lack", "n_free", "n_weak")
    up = F.row_number().over(W.partitionBy(by, free).orderBy(rank))
    down = F.row_number().over(W.partitionBy(by, weak).orderBy("final", rank))
    df = df.withColumn("up", F.when(free, up)).withColumn("down", F.when(weak, down)).withColumn("swaps", swaps)
    return df.withColumn("in_final", F.when(free, F.col("up") <= F.col("swaps")).when(weak, F.col("down") > F.col("swaps")).otherwise(F.col("in_top"))).drop("lack", "n_weak")


def blend(df: DataFrame, by: str, top: int = 10, most: int = 2, least: int = 2, rank: str = "rank", name: str = "blended") -> DataFrame:
    """The order after the domain cap and the injection. An injected row takes the slot of the one that it displaces; the
    top is then sorted by score; displaced rows go to the end in the order of their displacement."""
    df = inject_exploration(domain_cap(df, by, top, most, rank), by, least, rank)
    swapped = F.col("up") <= F.col("swaps")
    # slot that the k-th injected row gets: the slot of the k-th displaced one
    slots = F.collect_list(F.when(F.col("down") <= F.col("swaps"), F.struct("down", "slot"))).over(W.partitionBy(by))
    df = df.withColumn("_slots", F.array_sort(slots)).withColumn("_slot", F.when(swapped, F.try_element_at("_slots", F.col("up").cast("int"))["slot"]).otherwise(F.col("slot")))
    injected = F.col("swaps") > 0
    group = F.when(F.col("in_final"), 0).when(F.col("down") <= F.col("swaps"), 2).otherwise(1)
    within = F.when(F.col("in_final") & injected, F.struct((-F.col("final")).alias("a"), F.col("_slot").cast("double").alias("b"))).when(F.col("in_final"), F.struct(F.lit(0.0).alias("a"), F.col("_slot").cast("double").alias("b"))).when(F.col("down") <= F.col("swaps"), F.struct(F.lit(0.0).alias("a"), F.col("down").cast("double").alias("b"))).otherwise(F.struct(F.lit(0.0).alias("a"), F.col(rank).cast("double").alias("b")))
    return df.withColumn(name, F.row_number().over(W.partitionBy(by).orderBy(group, within))).drop("_slots", "_slot", "turn", "slot", "in_top", "in_final", "up", "down", "swaps", "n_free")


def vote_boost(df: DataFrame, votes: DataFrame, key: str, step: float = 0.03) -> DataFrame:
    return df.join(votes, key, "left").withColumn("final", T.clamp(F.col("final") + step * F.signum(F.coalesce("votes", F.lit(0)).cast("double"))))


def vote_order(df: DataFrame, votes: DataFrame, key: str, by: str, rank: str = "rank", name: str = "voted") -> DataFrame:
    """vote_boost, rounded to three places; a set in which a vote counted is sorted by score anew, others keep their order."""
    df = vote_boost(df, votes, key).withColumn("final", F.when(F.coalesce("votes", F.lit(0)) != 0, F.round("final", 3)).otherwise(F.col("final")))
    counted = F.max((F.coalesce("votes", F.lit(0)) != 0).cast("int")).over(W.partitionBy(by))
    df = df.withColumn("_any", counted)
    return df.withColumn(name, F.row_number().over(W.partitionBy(by).orderBy(F.when(F.col("_any") == 1, -F.col("final")).otherwise(0.0), rank))).drop("_any")


def over_optimised(title: Column, query: Column) -> Column:
    words = F.filter(T.words(F.regexp_replace(F.lower(T.safe(query)), "[^\\p{L}\\p{N}_ \\t\\n\\r]", " ")), lambda w: F.length(w) > 3)
    low, n = T.lowered(T.safe(title)), T.word_count(title)

    def penalty(w: Column) -> Column:
        share = F.size(F.filter(w, lambda x: low.contains(x))) / F.greatest(F.size(w), F.lit(1))
        return F.when(F.size(w) < 2, 0.0).when((share >= 0.8) & (n >= 6), 0.12).when((share >= 0.65) & (n >= 8), 0.07).otherwise(0.0)

    return T.let(words, penalty)
