"""Exact deduplication with Structured Streaming state (DataFrame operations only).

Documents land as (digest, id, locator) rows and flow through a stateful streaming aggregation. Its RocksDB state is
keyed by digest and never expires: it holds how often the digest came, the id that stays and where that text lies. A
digest that came more than once is a hit; the whole bytes of all hits are then compared, and a digest with unequal
bytes under it is resolved by the bytes themselves. Digests of more than a share of all rows, of which there are few,
are sent to all tasks, so that no task gets all copies of one text.

Defined results: a null text counts as empty; null ids take part but never stay unless all ids of the group are null
(then keep_id is null and kept is true); repeated rows with one id count in group_size and share its `kept`; an empty
table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, long_id, table

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # each store would hold 4 MB of empty preallocated file, for as long as it is loaded
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def stream_state(spark: SparkSession, landed: DataFrame, scratch: Scratch, files_per_trigger: int) -> DataFrame:
    """The state after all of `landed` (path scratch/landed) has streamed by: digest, n, keep_id, locator."""
    rows = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(scratch.path("landed"))
    state = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "locator")).alias("keep"))
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)

    def emit(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{scratch.path('state')}/batch={batch_id}")

    try:
        query = state.writeStream.outputMode("update").option("checkpointLocation", scratch.path("stream")).trigger(availableNow=True).foreachBatch(emit).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = "digest binary, n long, keep struct<doc_id: long, locator: string>"
    found = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(scratch.path("state"))
    return found.groupBy("digest").agg(F.max("n").alias("n"), F.max("keep").alias("keep"))


#: Digests of hits, of 100 bytes each, are sent to all tasks up to this many.
SENT = 200_000


def exact_dedup(spark: SparkSession, docs: DataFrame, files_per_trigger: int = 4096, sent: int = SENT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, locator of every row of docs."""
    scratch = Scratch(spark, "exact")
    full = docs.select(long_id(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2(F.col("text"), 256)))
    landed = scratch.keep(full.select("digest", "doc_id", F.input_file_name().alias("locator")), "landed")
    rows = landed.count()
    if rows:
        state = scratch.keep(stream_state(spark, landed, scratch, files_per_trigger), "final")
        scratch.drop("stream", "state")  # the stream has ended, its last state is kept
    else:
        state = spark.createDataFrame([], "digest binary, n long, keep struct<doc_id: long, locator: string>")
    found = state.select("digest", "n", F.col("keep.doc_id").alias("keep_id"), F.col("keep.locator").alias("keep_locator"))
    hits = found.filter("n > 1")
    few = hits.count() <= sent

    # Whole bytes of hits: copies collapse before the shuffle, as the text is a grouping key.
    repeated = full.join(F.broadcast(hits.select("digest")), "digest", "left_semi") if few else full
    bytes_of = repeated.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    bytes_of = scratch.keep(bytes_of.select("digest", "keep_id", "n", F.xxhash64("text").alias("of_text")), "hits")
    mixed = bytes_of.groupBy("digest").agg(F.count("*").alias("variants")).filter("variants > 1").select("digest")

    ids = landed.select("digest", "doc_id", "locator")
    single = [F.lit(1).cast("long").alias("n"), F.col("doc_id").alias("keep_id"), F.col("locator").alias("keep_locator")]
    if few:  # a row without a hit is its own group
        plain = ids.join(F.broadcast(hits), "digest", "left")
        out = [F.coalesce("n", single[0]).alias("n"), F.when(F.col("n").isNull(), single[1]).otherwise(F.col("keep_id")).alias("keep_id"), F.when(F.col("n").isNull(), single[2]).otherwise(F.col("keep_locator")).alias("keep_locator")]
        plain = plain.select("digest", "doc_id", *out)
    else:  # fewer than `sent` digests can have more than rows / sent copies
        most = rows // max(1, sent)
        hot, rest = F.broadcast(hits.filter(F.col("n") > most)), found.filter((F.col("n") <= most) | (F.col("n") == 1))
        plain = ids.join(hot, "digest").drop("locator").unionByName(ids.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rest, "digest").drop("locator"))
    if not mixed.isEmpty():  # one digest over unequal bytes: those rows go by the bytes
        odd = full.join(mixed, "digest", "left_semi").select("digest", "doc_id", F.xxhash64("text").alias("of_text")).join(bytes_of, ["digest", "of_text"])
        plain = plain.join(mixed, "digest", "left_anti").unionByName(odd.select("digest", "doc_id", "n", "keep_id", F.lit(None).cast("string").alias("keep_locator")))
    return plain.select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), F.col("keep_locator").alias("locator"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, table(spark, sf_dir, "documents")).drop("locator")


SQL = {
    "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
}
