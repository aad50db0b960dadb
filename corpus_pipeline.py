"""The corpus pipeline: documents -> clean, deduplicated, decontaminated, packed sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the
last return the columns of documents. Toxicity and decontamination decide row by row, whatever the ids. Exact dedup
decides by id and text: of rows that are equal in both one stays, and rows without an id stay if no equal text has one.
Near dedup decides by id; rows without an id stay. The toxicity, near-duplicate, decontamination and packing stages
can't be expressed in SQL. Their operators have tests of their own in tests/llm, and test_pipeline.py holds the whole
against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.common import Scratch, long_id, table
from quillrank.llm.decontaminate import uncontaminated
from quillrank.llm.exact_dedup import exact_dedup
from quillrank.llm.near_dup import near_duplicates
from quillrank.llm.packing import pack_documents
from quillrank.llm.toxicity import clean

#: Ids of rows that go are sent to all tasks up to this many (100 bytes each at most); more go by a shuffle.
SENT = 500_000
#: Words that a packing worker remembers; fewer than alone, as its process has served other stages.
PACK_WORDS = 250_000


def without(docs: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of docs whose keys, nulls included, aren't among those of gone."""
    gone = gone.select(*[F.col(k).alias(f"_gone_{k}") for k in keys])
    small = F.broadcast(gone) if gone.count() <= SENT else gone
    same = [docs[k].eqNullSafe(F.col(f"_gone_{k}")) for k in keys]
    return docs.join(small, same, "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go."""
    return clean(spark, docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    scratch = Scratch(spark, "copies")
    decided = scratch.keep(exact_dedup(spark, docs).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "kept"), "decided")
    keyed = docs.withColumn("_id", long_id()).withColumn("_sha", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    out = without(keyed, decided.filter("not kept").select("_id", "_sha").distinct(), ["_id", "_sha"])
    again = scratch.keep(decided.filter("kept").groupBy("_id", "_sha").agg(F.count("*").alias("n")).filter("n > 1").select("_id", "_sha"), "again")
    if not again.isEmpty():  # rows that are equal in id and text
        twice = out.join(F.broadcast(again.select(F.col("_id").alias("_a"), F.col("_sha").alias("_b"))) if again.count() <= SENT else again.select(F.col("_id").alias("_a"), F.col("_sha").alias("_b")), F.col("_id").eqNullSafe(F.col("_a")) & (F.col("_sha") == F.col("_b")), "left_semi")
        out = without(out, again, ["_id", "_sha"]).unionByName(twice.dropDuplicates(["_id", "_sha"]))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the smallest doc_id stays."""
    decided = Scratch(spark, "near-copies").keep(near_duplicates(spark, docs).select(F.col("doc_id").alias("_id"), "kept"), "decided")
    gone = decided.filter("_id is not null").groupBy("_id").agg(F.max("kept").alias("kept")).filter("not kept")
    return without(docs.withColumn("_id", long_id()), gone, ["_id"]).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return uncontaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(spark, docs, cached=PACK_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
    return docs
