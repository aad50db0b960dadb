"""Parquet sources: explicit column pruning, and the reshaping of landed tables into result records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U


#: Tables below this size for each core are dealt to all cores, as one small file is one task.
SMALL = 16 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small table's rows dealt to all cores; a large one has tasks enough and stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < SMALL * cores else df


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, url, domain, title, content, word_count of landed pages."""
    p = spread(read(spark, sf_dir, "pages")).withColumn("content", H.plain_text(F.col("html")))
    return p.select(F.col("page_id").alias("pos"), "url", U.host(F.col("url")).alias("domain"), H.title(F.col("html"), F.col("url")).alias("title"), "content", T.word_count(F.col("content")).alias("word_count"))


def union_sources(*frames: DataFrame) -> DataFrame:
    """Records of several sources in their order; absent columns become null."""
    out = None
    for k, f in enumerate(frames):
        f = f.withColumn("src_order", F.lit(k))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def archive_fallback(df: DataFrame, archive: DataFrame, key: str, least_words: int = 150) -> DataFrame:
    """Short texts are replaced by an archived copy if it has more words."""
    a = archive.select(key, F.col("content").alias("_a"), F.col("word_count").alias("_n"))
    j = df.join(a, key, "left")
    use = (F.col("word_count") < least_words) & (F.col("_n") > F.col("word_count"))
    return j.withColumn("archive_used", F.coalesce(use, F.lit(False))).withColumn("content", F.when(F.col("archive_used"), F.col("_a")).otherwise(F.col("content"))).withColumn("word_count", F.when(F.col("archive_used"), F.col("_n")).otherwise(F.col("word_count"))).drop("_a", "_n")
