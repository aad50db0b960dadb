"""Connected components of a link table by alternating large and small stars; every round is a pair of aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, tag: str, most_rounds: int = 40) -> DataFrame:
    """(id, component) for all ids in links (a, b); component is the smallest id reachable. Raises if it hasn't settled."""
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{tag}-edges")
    size = None
    for r in range(most_rounds):
        # large star: all larger neighbours of u move to u's smallest neighbour (or u itself)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = scratch.keep(small, f"{tag}-{r}")
        scratch.drop(f"{tag}-edges" if not r else f"{tag}-{r - 1}")
        x = edges.agg(F.count("*").alias("n"), F.countDistinct("u").alias("us"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        now = (x["n"], x["s"])
        if now == size and x["n"] == x["us"]:
            break
        size = now
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
