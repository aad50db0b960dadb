"""Streaming versions of the store's memories: vote sums, domain means and the query log.

Each takes a streaming DataFrame, keeps (sum, count)-like state for each key and writes changed rows of every micro-batch
to a folder; `latest_state` reads the state after the last of them. The state holds one row a key, never the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vote_sums(votes: DataFrame, url: str = "url", value: str = "vote") -> DataFrame:
    """Sum and number of the votes of each url."""
    return votes.groupBy(F.col(url).alias("key")).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def domain_means(rows: DataFrame, domain: str, score: str, at: str) -> DataFrame:
    """Pages, sum of scores and last time of each domain; the mean is total / n."""
    return rows.groupBy(F.col(domain).alias("key")).agg(F.sum(score).alias("total"), F.count("*").alias("n"), F.max(at).alias("last_seen"))


def query_log(log: DataFrame) -> DataFrame:
    """query, intent, ts -> of each normalised query the first spelling, the last intent and the number of searches."""
    key = F.left(F.sha2(F.lower(F.trim("query")), 256), F.lit(32)).alias("key")
    return log.groupBy(key).agg(F.min(F.struct("ts", "query"))["query"].alias("query"), F.max(F.struct("ts", "intent"))["intent"].alias("intent"), F.count("*").alias("n"))


def run_available(state: DataFrame, path: str) -> None:
    """Stream all that is there into path/state, one folder a micro-batch; a repeated micro-batch overwrites its own."""

    def emit(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/state/b{batch_id}")

    query = state.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(emit).start()
    query.awaitTermination()


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    """The last row that was written for each key."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/state")
    rest = [c for c in rows.columns if c not in ("key", "batch")]
    return rows.groupBy("key").agg(F.max_by(F.struct(*rest), "batch").alias("s")).select("key", "s.*")
