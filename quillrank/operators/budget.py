"""Crawl budget: pools, depth limits and sequential grants as running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: (exploration share, depth multiplier) of each intent; fixed values.
PROFILES = {"deep_research": (0.35, 1.4), "freshness_sensitive": (0.15, 0.8), "navigational": (0.05, 0.6), "informational": (0.20, 1.0)}


def pools(total: int, intent: str) -> tuple[int, int]:
    explore = max(1, int(total * PROFILES.get(intent, PROFILES["informational"])[0]))
    return total - explore, explore


def depth_limit(trust: Column, intent: str = "informational") -> Column:
    base = F.when(F.coalesce(trust, F.lit(0.5)) >= 0.75, 5).when(F.coalesce(trust, F.lit(0.5)) >= 0.55, 3).otherwise(1)
    return F.greatest(F.bround(base * F.lit(PROFILES[intent][1]), 0).cast("int"), F.lit(1))


def allocate(df: DataFrame, by: str, pool: int, order: str = "pos") -> DataFrame:
    """Grants of the sequential rule grant = min(want, limit - used, pool) for requests (by, domain, want, limit) in order."""
    inner = W.partitionBy(by, "domain").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    outer = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("cum", F.sum("want").over(inner))
    df = df.withColumn("capped", F.least("limit", "cum") - F.least(F.col("limit"), F.col("cum") - F.col("want")))
    df = df.withColumn("total", F.sum("capped").over(outer))
    return df.withColumn("granted", F.least(F.lit(pool), "total") - F.least(F.lit(pool), F.col("total") - F.col("capped"))).drop("cum", "capped", "total")


def exploration_sample(df: DataFrame, key: str, most: int, seed: str = "0") -> DataFrame:
    """A repeatable sample of the unknown or little trusted."""
    return df.filter(F.coalesce("trust", F.lit(0.0)) < 0.5).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))).limit(most)


def remaining(total: int, used: int, explored: int) -> int:
    return total - used - explored


def one_per_domain(df: DataFrame, priority: str = "priority", pos: str = "pos") -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy("domain").orderBy(F.desc(priority), pos))).filter("_r = 1").drop("_r")


def multiplied(trust: Column, score: Column) -> Column:
    """Priority of a link to a domain: its quality times 0.70 plus the domain's trust."""
    return F.coalesce(score, F.lit(0.5)) * (0.70 + F.coalesce(trust, F.lit(0.5)))


def by_trust(df: DataFrame, pos: str = "pos") -> list:
    """The order of domains or seeds: trust first, then their own order."""
    return [F.desc(F.coalesce("trust", F.lit(0.5))), pos]


def feasible(df: DataFrame, by: str, pool: int) -> DataFrame:
    """Candidates (by, domain, used, limit) of requests whose pool isn't empty and whose domain has pages left."""
    spent = F.sum("used").over(W.partitionBy(by))
    return df.withColumn("_spent", spent).filter((F.col("_spent") < pool) & (F.col("used") < F.col("limit"))).drop("_spent")


def allocate_exploration(df: DataFrame, by: str, pool: int, order: str = "pos") -> DataFrame:
    """granted: one page for the first candidate of each domain, as long as the exploration pool lasts."""
    first = F.row_number().over(W.partitionBy(by, "domain").orderBy(order))
    df = df.withColumn("_first", first)
    turn = F.row_number().over(W.partitionBy(by, F.col("_first") == 1).orderBy(order))
    return df.withColumn("granted", F.when((F.col("_first") == 1) & (turn <= pool), 1).otherwise(0)).drop("_first")


def unknown_domains(candidates: DataFrame, trust: DataFrame, by: str, most: int = 4, seed: str = "0") -> DataFrame:
    """Of each request the `most` candidates of domains that are unknown or trusted less than 0.5, in an order by hash."""
    j = candidates.filter("domain <> ''").join(trust, "domain", "left").filter(F.coalesce("trust", F.lit(0.0)) < 0.5)
    turn = F.row_number().over(W.partitionBy(by).orderBy(F.md5(F.concat("url", F.lit(seed))), "url"))
    return j.withColumn("turn", turn).filter(F.col("turn") <= most)


def summary(grants: DataFrame, probes: DataFrame, by: str, total: int, intent: str) -> DataFrame:
    """A row for each request with grants (by, domain, granted) or probes: what is left of both pools and who got pages."""
    trust_pool, explore_pool = pools(total, intent)
    g = grants.filter("granted > 0").groupBy(by, "domain").agg(F.sum("granted").alias("n")).groupBy(by).agg(F.sum("n").alias("used"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("domain", "n")))).alias("per_domain"))
    p = probes.filter("granted > 0").groupBy(by).agg(F.sum("granted").alias("explored"), F.sort_array(F.collect_set("domain")).alias("exploration_domains"))
    used, explored = F.coalesce("used", F.lit(0).cast("long")), F.coalesce("explored", F.lit(0).cast("long"))
    return g.join(p, by, "full_outer").select(
        by, F.lit(total).alias("budget_total"), (F.lit(total) - used - explored).alias("budget_remaining"), (F.lit(trust_pool) - used).alias("trust_pool_remaining"),
        F.lit(explore_pool).alias("explore_pool_total"), (F.lit(explore_pool) - explored).alias("explore_pool_remaining"), explored.alias("explore_pool_used"),
        F.lit(intent).alias("intent"), "exploration_domains", "per_domain",
    )
