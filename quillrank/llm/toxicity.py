"""Toxicity by non-negative positive-unlabelled learning.

Training takes confirmed toxic documents (P) and unlabelled text (U), never confirmed clean ones. With the class prior
pi (the share of toxic rows among the labelled training rows, counted over all of them), the risk of a classifier is
pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)): the part of U's loss that toxic documents in U cause is taken off, and the
rest is held at zero or above. Where it falls below, the step goes the other way. The classifier is linear over the
presence of hashed words and word beginnings, kept where they are more frequent in P than in U, and is trained with
numpy on the driver from at most MOST_P and MOST_U documents, drawn by a hash of their ids, each with at most
MOST_FEATURES features, drawn by their hash. Every whole text is scored on the executors.

Labels are read only of rows whose crc32(doc_id) mod 4 is not 2; an id with several labels is toxic if one of them says
so, and of several texts of an id the smallest trains. Defined results: null and blank texts get the score of a text
without features; without any toxic training label every score is about e^-40; repeated rows give repeated rows; null
ids are scored too; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHE_WORDS, forgetting, long_id, ship, table

WORD = re.compile(r"[^\W\d_]+")
BITS, BEGINNINGS = 20, (4, 5)
#: Bounds of the training sample (documents), so that it fits the driver at any size of the corpus.
MOST_P, MOST_U, MOST_FEATURES = 3000, 6000, 8192
THRESHOLD, HELD_OUT = 0.3, 2


def features(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-cased word: itself and its beginnings."""
    parts = ["=" + word, *("^" + word[:k] for k in BEGINNINGS if len(word) >= k)]
    return tuple(xxhash.xxh3_64_intdigest(p) >> (64 - BITS) for p in parts)


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


class FeatureCache(dict):
    """word -> its features in the model (all if there is none); emptied when full."""

    def __init__(self, keep: set[int] | None = None):
        super().__init__()
        self.keep = keep

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        f = features(word)
        f = self[word] = f if self.keep is None else tuple(x for x in f if x in self.keep)
        return f


@dataclass
class Model:
    """weights: of hashed features; bias: log odds of a document without any."""

    weights: dict[int, float]
    bias: float

    def scores(self, texts: list[str | None], cache: FeatureCache) -> list[float]:
        out = []
        for t in texts:
            found = {f for fs in filter(None, map(cache.__getitem__, words_of(t))) for f in fs}
            z = self.bias + sum(self.weights[f] for f in sorted(found))
            out.append(float(1 / (1 + np.exp(-np.clip(z, -40, 40)))))
        return out


def screened(pos: list[np.ndarray], unl: list[np.ndarray], least: int = 5, ratio: float = 3.0, sigmas: float = 5.0, most: int = 20_000) -> np.ndarray:
    """Features in at least `least` toxic documents, `ratio` times as frequent there as in U and by so many standard errors."""
    n = 1 << BITS
    p = np.bincount(np.concatenate(pos), minlength=n)
    u = np.bincount(np.concatenate(unl), minlength=n) if unl else np.zeros(n)
    rate_p, rate_u = p / len(pos), (u + 0.5) / (len(unl) + 1)
    lift = np.where((p >= min(least, max(1, len(pos) // 4))) & (rate_p >= ratio * rate_u), (rate_p - rate_u) / np.sqrt(rate_u / len(pos) + 1e-9), 0)
    best = np.argsort(-lift, kind="stable")[:most]
    return np.sort(best[lift[best] >= sigmas])


def nnpu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, epochs: int = 300, rate: float = 0.05, l2: float = 1e-4, beta: float = 0.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-negative PU risk with the logistic loss, minimised by Adam: (features, weights, bias)."""
    kept = screened(pos, unl)
    docs = [kept.searchsorted(x[np.isin(x, kept)]) for x in [*pos, *unl]]
    lengths = np.array([len(d) for d in docs])
    cols, rows = np.concatenate(docs).astype(np.int64), np.repeat(np.arange(len(docs)), lengths)
    m, np_, nu = len(kept), len(pos), max(1, len(unl))
    w, b = np.zeros(m), float(np.log(prior / (1 - prior)))
    mean, var, at = np.zeros(m + 1), np.zeros(m + 1), 0
    is_p = np.arange(len(docs)) < np_
    for _ in range(epochs):
        z = np.bincount(rows, weights=w[cols], minlength=len(docs)) + b
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        minus = np.logaddexp(0, z)  # loss of calling it clean
        negative = minus[~is_p].mean() - prior * minus[is_p].mean() if len(unl) else 0.0
        up = np.where(is_p, -(1 - s) * prior / np_, 0.0)  # of pi * R_P(+)
        down = np.where(is_p, -prior * s / np_, s / nu)  # of R_U(-) - pi * R_P(-)
        g = up + down if negative >= -beta else -down
        grad = np.append(np.bincount(cols, weights=g[rows], minlength=m) + l2 * w, g.sum())
        at += 1
        mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad**2
        step = rate * (mean / (1 - 0.9**at)) / (np.sqrt(var / (1 - 0.999**at)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return kept, w, b


def fold():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


@forgetting
def hashed_features(batches):
    cache = FeatureCache()
    for b in batches:
        out = [np.unique(np.fromiter((f for w in words_of(t) for f in cache[w]), np.int32))[:MOST_FEATURES] for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(out, pa.list_(pa.int32()))], ["toxic", "features"])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, most_p: int = MOST_P, most_u: int = MOST_U) -> Model:
    ship(spark)
    known = labels.select(long_id(), F.col("toxic").cast("int").alias("toxic")).filter((fold() != HELD_OUT) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = docs.select(long_id()).filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    known = known.join(ids, "doc_id", "left_semi")
    counts = known.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("p")).first()
    if not counts["p"]:
        return Model({}, -40.0)
    prior = min(0.9, max(1e-3, counts["p"] / counts["n"]))
    drawn = F.xxhash64("doc_id", F.lit(4))
    p = known.filter("toxic = 1").orderBy(drawn, "doc_id").limit(most_p).select("doc_id", F.lit(1).alias("toxic"))
    u = ids.filter(fold() != HELD_OUT).orderBy(drawn, "doc_id").limit(most_u).select("doc_id", F.lit(0).alias("toxic"))
    wanted = F.broadcast(p.unionByName(u))  # most_p + most_u ids at most
    sample = docs.select(long_id(), F.col("text").cast("string").alias("text")).join(wanted, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")
    got = sample.mapInArrow(hashed_features, "toxic int, features array<int>").toArrow()
    flat = got.column("features").combine_chunks()
    flat = flat if isinstance(flat, pa.ListArray) else pa.concat_arrays(flat.chunks)
    values, at = flat.values.to_numpy(zero_copy_only=False), flat.offsets.to_numpy()
    toxic = got.column("toxic").to_numpy()
    rows = [values[at[i] : at[i + 1]] for i in range(len(toxic))]
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i]), rows[i].tobytes()))
    kept, w, bias = nnpu([rows[i] for i in order if toxic[i]], [rows[i] for i in order if not toxic[i]], prior)
    return Model({int(f): float(x) for f, x in zip(kept, w, strict=True)}, bias)


def scorer(sent):
    @forgetting
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        cache = FeatureCache(set(m.weights))
        for a in texts:
            s = []
            for at in range(0, len(a), 512):
                s += m.scores(a.slice(at, 512).to_pylist(), cache)
            yield pa.array(s, pa.float64())

    return run


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    score = scorer(spark.sparkContext.broadcast(train(spark, docs, labels)))  # at most as many weights as nnpu keeps

    def scored(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *score([b.column("text")])], ["doc_id", "score"])

    rows = docs.select(long_id(), F.col("text").cast("string").alias("text")).mapInArrow(scored, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, whatever their ids, whose score is below the threshold. Only texts go to Python and only scores
    come back."""
    score = F.arrow_udf(scorer(spark.sparkContext.broadcast(train(spark, docs, labels))), "double")
    return docs.filter(score(F.col("text").cast("string")) < threshold)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL: dict[str, str] = {}
