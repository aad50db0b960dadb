"""Quality by weak labels: overlapping heuristic labellers, expectation-maximisation, a hashed linear scorer.

Each labeller looks at a whole text and votes good, bad or nothing. How often each pattern of votes occurs is counted
over all documents (3^labellers patterns at most, so the counts fit the driver). EM on those counts estimates how each
labeller votes given the hidden class, without any true label, and with it the posterior of every pattern. The
posteriors of a sample of at most MOST documents, drawn by a hash of their ids, are the soft labels that train a
logistic scorer over hashed word shapes, which then scores every whole text.

Defined results: null and blank texts score 0 and are not kept; repeated rows give repeated rows; of several
texts of an id the smallest trains; null ids are scored too; an empty table gives an empty result; other columns are ignored. Labels are used for evaluation only.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHE_WORDS, Scratch, long_id, table

MOST, BITS, THRESHOLD = 8000, 14, 0.5
LETTERS = re.compile(r"[^\W\d_]+")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
SYMBOLS = re.compile(r"[^\w\s.,;:'\"()?!-]")
SENTENCE = re.compile(r"[.!?\n]+")
END = re.compile(r"[.!?](?:\s|$)")


def band(x: float, bad: float, good: float) -> int:
    """-1 on bad's side, 1 on good's side, 0 between."""
    if bad > good:
        return -1 if x >= bad else 1 if x <= good else 0
    return -1 if x <= bad else 1 if x >= good else 0


def repetition(text: str, words: list[str]) -> tuple[float, float]:
    """Shares of words that repeat the word before, and of sentences that are not new."""
    parts = [x for x in map(str.strip, SENTENCE.split(text)) if x]
    return sum(map(str.__eq__, words, words[1:])) / max(1, len(words)), 1 - len(set(parts)) / max(1, len(parts))


def votes(text: str) -> list[int]:
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    letters = sum(map(len, LETTERS.findall(text)))
    bare = [w.strip(".,;:!?'\"()").lower() for w in words]
    again, said = repetition(text, words)
    counts: dict[str, int] = {}
    for w in bare:
        counts[w] = counts.get(w, 0) + 1
    return [
        band(len(SYMBOLS.findall(text)) / size, 0.04, 0.01),
        band(len(UPPER.findall(text)) / max(1, letters), 0.3, 0.1),
        band(letters / size, 0.65, 0.75),
        band(len(set(lines)) / max(1, len(lines)), 0.6, 0.8),
        band(sum(len(w) == 1 and not w.isalnum() for w in words) / n, 0.1, 0.02),
        band(text.count("!") / n, 0.2, 0.05),
        band(len(END.findall(text)) / n, 0.01, 0.04),
        band(max(counts.values(), default=0) / n, 0.3, 0.2) if n >= 20 else 0,
        band(len(words), 5, 40),
        band(again, 0.2, 0.03),
        band(said, 0.5, 0.15),
    ]


def form(run: str) -> str:
    """How a run of letters is written: capitals, a capital first, or small."""
    return "A" if run.isupper() and len(run) > 1 else "Aa" if run[0].isupper() else "a"


class Classes(dict):
    """Code of a character -> the letter or digit that stands for its class, or itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = "9" if c.isdecimal() else c if not c.isalpha() else "A" if c.isupper() else "a" if c.islower() else c
        self[code] = kind
        return kind


class Shapes(dict):
    """word of character classes -> hashed shape, cached; there are far fewer such words than words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        s = re.sub(r"\d+", "9", LETTERS.sub(lambda m: form(m[0]), word))
        h = self[word] = xxhash.xxh3_64_intdigest(re.sub(r"(.)\1+", r"\1\1", s)) >> (64 - BITS)
        return h


CLASSES, SHAPES = Classes(), Shapes()


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shapes, shape pairs and line lengths, and the roots of their shares."""
    words = text.split()
    ids = np.fromiter(map(SHAPES.__getitem__, text.translate(CLASSES).split()), np.int64, len(words))
    pairs = (ids[:-1] * 31 + ids[1:] * 7 + 11) % (1 << BITS)
    lines = text.split("\n")
    extra = np.array([xxhash.xxh3_64_intdigest(f"lines {min(20, int(np.log2(1 + len(x.split()))))}") >> (64 - BITS) for x in lines], np.int64)
    levels = [f"again {k} {min(9, int(10 * x))}" for k, x in enumerate(repetition(text, words))]
    out, value = [np.array([xxhash.xxh3_64_intdigest(x) >> (64 - BITS) for x in levels], np.int64)], [np.full(2, 0.5)]
    for x in (ids, pairs, extra):
        if len(x):
            u, c = np.unique(x, return_counts=True)
            out.append(u)
            value.append(np.sqrt(c / len(x)))
    return np.concatenate(out or [np.empty(0, np.int64)]), np.concatenate(value or [np.empty(0)])


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good for each pattern, P(vote | class) as [labeller, class, vote + 1], prior of good)."""
    n, m = patterns.shape
    post = np.clip(0.5 + patterns.mean(axis=1), 0.02, 0.98)  # labellers are better than chance: start at the majority
    told, prior = np.zeros((m, 2, 3)), 0.5
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        prior = float(np.clip(weight[1].sum() / weight.sum(), 0.01, 0.99))
        for v in (-1, 0, 1):
            told[:, :, v + 1] = (weight @ (patterns == v)).T + smooth
        told /= told.sum(axis=2, keepdims=True)
        log = np.stack([np.log(told[np.arange(m), k][np.arange(m), patterns + 1]).sum(axis=1) for k in (0, 1)])
        odds = log[1] - log[0] + np.log(prior / (1 - prior))
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, told, prior


def logistic(rows: list[tuple[np.ndarray, np.ndarray]], soft: np.ndarray, epochs: int = 300, rate: float = 0.1, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    n, dim = len(rows), 1 << BITS
    of = np.repeat(np.arange(n), [len(r[0]) for r in rows])
    cols, vals = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    w, b = np.zeros(dim), 0.0
    mean, var = np.zeros(dim + 1), np.zeros(dim + 1)
    for t in range(1, epochs + 1):
        z = np.bincount(of, weights=w[cols] * vals, minlength=n) + b
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - soft) / n
        grad = np.append(np.bincount(cols, weights=g[of] * vals, minlength=dim) + l2 * w, g.sum())
        mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad**2
        step = rate * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def vote_rows(batches):
    for b in batches:
        pattern = ["".join("-0+"[v + 1] for v in votes(t)) if t.strip() else None for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pattern, pa.string())], ["doc_id", "pattern"])


def vectors(batches):
    for b in batches:
        some = b.column("text").to_pylist()
        rows, pattern = [vector(t) for t in some], ["".join("-0+"[v + 1] for v in votes(t)) for t in some]
        yield pa.RecordBatch.from_arrays([pa.array(pattern, pa.string()), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["pattern", "ids", "shares"])


def quality(spark: SparkSession, docs: DataFrame, most: int = MOST, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, weak_label (posterior of its votes), score, kept of every row of docs."""
    scratch = Scratch(spark, "quality")
    rows = docs.select(long_id(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    voted = scratch.keep(rows.mapInArrow(vote_rows, "doc_id long, pattern string"), "votes")
    found = voted.filter("pattern is not null").groupBy("pattern").count().collect()  # 3^11 patterns at most
    if not found:
        return rows.select("doc_id", F.lit(None).cast("double").alias("weak_label"), F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    names = sorted(r["pattern"] for r in found)
    count = {r["pattern"]: r["count"] for r in found}
    patterns = np.array([["-0+".index(c) - 1 for c in p] for p in names])
    post, _, _ = expectation_maximisation(patterns, np.array([count[p] for p in names], float))
    soft = dict(zip(names, post.tolist(), strict=True))

    drawn = voted.filter("pattern is not null and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").limit(most)
    one = rows.filter(F.col("text").rlike("\\S")).join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # however often an id comes
    got = one.select("text").mapInArrow(vectors, "pattern string, ids array<long>, shares array<double>").collect()  # `most` rows of bounded width
    got = sorted(got, key=lambda r: (r["pattern"], r["ids"], r["shares"]))
    w, b = logistic([(np.array(r["ids"], np.int64), np.array(r["shares"])) for r in got], np.array([soft.get(r["pattern"], 0.5) for r in got])) if got else (np.zeros(1 << BITS), 0.0)
    sent = spark.sparkContext.broadcast((w.astype(np.float32), float(b), soft))

    def score(batches):
        w, b, soft = sent.value
        for batch in batches:
            weak, s = [], []
            for t in batch.column("text").to_pylist():
                if not t.strip():
                    weak.append(None)
                    s.append(0.0)
                    continue
                weak.append(soft.get("".join("-0+"[v + 1] for v in votes(t))))
                ids, shares = vector(t)
                s.append(float(1 / (1 + np.exp(-np.clip(w[ids] @ shares + b, -40, 40)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(weak, pa.float64()), pa.array(s, pa.float64())], ["doc_id", "weak_label", "score"])

    return rows.mapInArrow(score, "doc_id long, weak_label double, score double").withColumn("kept", F.col("score") >= threshold)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
