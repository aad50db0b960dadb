"""Shared helpers of the corpus operators: word splitting, 64-bit hashing, ranks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from ..scratch import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir", "ship"]

#: Entries that a worker's word cache holds before it is emptied (about 30 MB).
CACHE_WORDS = 150_000

U64 = np.uint64
MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_id(name: str = "doc_id"):
    return F.col(name).cast("long").alias(name)


class WordHash(dict):
    """bytes -> 64-bit hash, cached; emptied when full, so memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


HASHES = WordHash()


def forgetting(run):
    """run, a function of batches, whose worker gives back the memory of its caches after each task."""

    @wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            HASHES.clear()
            pa.default_memory_pool().release_unused()

    return inner


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), dtype=U64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser (fixed values)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def grams(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words, in order; none if there are fewer."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    h = np.zeros(n, U64)
    for j in range(k):
        h = h * U64(0x9E3779B97F4A7C15) + w[j : j + n]
    return mix(h)


def seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(salt))


def texts(column) -> Iterator[bytes | None]:
    """The UTF-8 bytes of an Arrow string column, a few rows in memory at a time."""
    for at in range(0, len(column), 512):
        yield from column.slice(at, 512).cast(pa.large_binary()).to_pylist()


def two_level_rank(df: DataFrame, by: list[str], order: str, rows: int, out: str, per_bucket: int = 50_000, then: tuple[str, ...] = ()) -> DataFrame:
    """Gapless ranks from 0 inside each `by` group without one task per group.

    Rows go to hashed buckets of about `per_bucket`; each bucket is numbered on its own and starts at the sum of the
    buckets before it. Only the table of bucket counts is scanned in order. `then` orders rows of equal `order`.
    """
    from pyspark.sql import Window as W

    n = max(8, -(-rows // per_bucket))
    df = df.withColumn("_b", F.pmod(F.xxhash64(F.col(order)), F.lit(n)))
    key = [*by, "_b"]
    before = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = df.groupBy(*key).agg(F.count("*").alias("_c")).withColumn("_s", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    starts = starts.repartition(*key)  # else the join deals the rows themselves by the group alone
    inner = df.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(order, *then)) - 1)
    return inner.join(starts, key).withColumn(out, (F.col("_s") + F.col("_r")).cast("long")).drop("_b", "_s", "_r")
