"""Benchmark decontamination by edit distance: CGK random walks, bit sampling, exact verification.

Texts are words (lower-cased runs of letters and digits). A document leaks an item if some stretch of it is within
`edit` x (item words) word edits of the whole item. Candidate windows have the item's size and are anchored: an item
within k edits of a window keeps one of k + 1 segments whole, so a window is looked at wherever one of the item's
GRAM-word grams stands (no leak is lost by that: a segment has at least GRAM words). Each window and each item is
embedded by CGK walks: at step j the walk writes the word it stands on and moves on if a hash of (j, word) says so, so
that edit distance becomes Hamming distance. Samples of the written words make the keys of hash tables; a window that
meets an item in any of the tables is verified by its exact edit distance. The items are the stated queries: they are
sent to the workers in blocks of bounded size, whatever their number.

Defined results: null and blank texts leak nothing; items without words can't leak; a leak of
an item without id contaminates a document and is not in item_ids; repeated rows give repeated rows;
empty tables give no leaks; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HASHES, U64, forgetting, grams, long_id, mix, seeds, ship, table

EDIT, GRAM = 0.2, 3
#: Walks, tables of each walk and sampled words of each table.
WALKS, TABLES, SAMPLES = 4, 24, 3
#: Items are sent to the workers in blocks of so many.
BLOCK = 20_000
WORD = re.compile(r"[^\W_]+")
PAD = U64(0)


def word_hashes(text: str | None) -> np.ndarray:
    words = WORD.findall((text or "").lower())
    return np.fromiter((HASHES[w.encode()] for w in words), dtype=U64, count=len(words))


def most_edits(n: int, edit: float) -> int:
    return int(n * edit + 1e-9)


def walks(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """The first `steps` words that a CGK walk writes for each window words[start : start + size]."""
    at = np.zeros(len(starts), np.int64)
    out = np.empty((len(starts), steps), U64)
    coin = seeds(steps, 1000 + walk)
    top = len(words) - 1
    for j in range(steps):
        inside = (at < sizes) & (starts + at <= top) & (starts + at >= 0)
        x = np.where(inside, words[np.clip(starts + at, 0, top)], PAD)
        out[:, j] = x
        at += ((x ^ coin[j]) * U64(0x9E3779B97F4A7C15) >> U64(63)).astype(np.int64)
    return out


def table_keys(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One key a window and table: the sampled places of the walk, which depend on the size alone."""
    steps = 2 * int(sizes.max())
    keys = np.empty((len(starts), WALKS * TABLES), U64)
    share = np.random.default_rng(20).random((WALKS, TABLES, SAMPLES))
    rows = np.arange(len(starts))
    for w in range(WALKS):
        out = walks(words, starts, sizes, w, steps)
        for t in range(TABLES):
            h = sizes.astype(U64) * U64(WALKS * TABLES) + U64(w * TABLES + t)
            for s in range(SAMPLES):
                h = mix(h * U64(0x9E3779B97F4A7C15) + out[rows, (share[w, t, s] * 2 * sizes).astype(np.int64)])
            keys[:, w * TABLES + t] = h
    return keys


class Items:
    """Hash tables of a block of benchmark items."""

    def __init__(self, ids: list[int], texts: list[str | None], edit: float):
        self.words = [word_hashes(t) for t in texts]
        self.ids, self.edit = ids, edit
        gram, item, place, short = [], [], [], []
        for i, w in enumerate(self.words):
            k = most_edits(len(w), edit)
            size = max(1, min(GRAM, len(w) // (k + 1)))  # the shortest whole segment
            g = grams(w, GRAM) if size == GRAM else grams(w, size) ^ U64(size)
            gram.append(g)
            item.append(np.full(len(g), i))
            place.append(np.arange(len(g)))
            if size < GRAM:
                short.append(size)
        cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
        gram, item, place = cat(gram, U64), cat(item, np.int64), cat(place, np.int64)
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.place = gram[order], item[order], place[order]
        self.short = sorted(set(short))
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        at = np.concatenate([[0], np.cumsum(self.sizes)])
        real = np.flatnonzero(self.sizes)
        keys = table_keys(np.concatenate(self.words), at[real], self.sizes[real]) if len(real) else np.empty((0, WALKS * TABLES), U64)
        flat = keys.ravel()
        order = np.argsort(flat, kind="stable")
        self.key, self.owner = flat[order], np.repeat(real, WALKS * TABLES)[order]

    def anchored(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of the windows to look at."""
        found = []
        for size in [*self.short, GRAM]:
            g = grams(words, size)
            g = g if size == GRAM else g ^ U64(size)
            lo, hi = np.searchsorted(self.gram, g, "left"), np.searchsorted(self.gram, g, "right")
            hit = np.flatnonzero(hi > lo)
            n = hi[hit] - lo[hit]
            which = np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(n.sum())
            found.append(np.stack([np.repeat(hit, n) - self.place[which], self.sizes[self.item[which]]]))
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        return both[0], both[1]

    def meet(self, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> set[tuple[int, int]]:
        """(window, item) that share a key of a table."""
        out: set[tuple[int, int]] = set()
        for at in range(0, len(starts), 8192):
            keys = table_keys(words, starts[at : at + 8192], sizes[at : at + 8192])
            lo, hi = np.searchsorted(self.key, keys, "left"), np.searchsorted(self.key, keys, "right")
            for w, t in zip(*np.nonzero(hi > lo), strict=True):
                out.update((at + int(w), int(i)) for i in self.owner[lo[w, t] : hi[w, t]])
        return out


def edits_inside(item: np.ndarray, part: np.ndarray) -> int:
    """Fewest word edits that make the item of some stretch of part."""
    row = np.zeros(len(part) + 1, np.int64)
    place = np.arange(len(part) + 1)
    for i, x in enumerate(item, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (part != x))
        row = np.minimum.accumulate(np.concatenate([[i], step]) - place) + place
    return int(row.min())


def leaks(items: Items, docs: list[np.ndarray]) -> list[dict[int, int]]:
    """For each document, the items that it leaks and their fewest edits."""
    out: list[dict[int, int]] = [{} for _ in docs]
    starts, sizes, of = [], [], []
    base = 0
    gap = np.zeros(1, U64)
    flat = []
    for d, words in enumerate(docs):
        s, n = items.anchored(words) if len(words) else (np.empty(0, np.int64), np.empty(0, np.int64))
        keep = s + n > 0
        starts.append(s[keep] + base)
        sizes.append(n[keep])
        of.append(np.full(int(keep.sum()), d))
        flat += [words, gap]
        base += len(words) + 1
    if not base:
        return out
    words, starts, sizes, of = np.concatenate(flat), np.concatenate(starts), np.concatenate(sizes), np.concatenate(of)
    first = np.cumsum([0, *(len(x) + 1 for x in docs)])
    by: dict[tuple[int, int], list[int]] = {}
    for w, i in items.meet(words, starts, sizes):
        by.setdefault((int(of[w]), i), []).append(int(starts[w] - first[of[w]]))
    for (d, i), places in by.items():
        n, k, item = len(items.words[i]), most_edits(len(items.words[i]), items.edit), items.words[i]
        least = k + 1
        for at in sorted(places):
            least = min(least, edits_inside(item, docs[d][max(0, at - k) : max(0, at + n + k)]))
            if not least:
                break
        if least <= k:
            out[d][i] = least
    return out


def item_blocks(spark: SparkSession, benchmark: DataFrame, edit: float, block: int) -> list:
    """Broadcasts of the items, a bounded part each; documents are never collected."""
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-items.count() // block))
    out = []
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        out.append(spark.sparkContext.broadcast(([r["item_id"] for r in part], [r["text"] for r in part], edit)))
    return out


#: Hash tables of item blocks that a worker process keeps between its tasks, by the id of their broadcast; at most so many.
TABLES_KEPT, _kept = 2, {}


def finder(sent):
    """texts (Arrow) -> for each text the items of a block that it leaks, with their fewest edits."""
    key = sent._jbroadcast.id() if getattr(sent, "_jbroadcast", None) is not None else None

    def run(texts):
        if key not in _kept:
            while len(_kept) >= TABLES_KEPT:
                _kept.pop(next(iter(_kept)))
            _kept[key] = Items(*sent.value)
        items = _kept[key]
        for at in range(0, len(texts), 1024):
            for hits in leaks(items, [word_hashes(t) for t in texts.slice(at, 1024).to_pylist()]):
                found: dict[int | None, int] = {}
                for i, edits in hits.items():
                    found[items.ids[i]] = min(edits, found.get(items.ids[i], edits))
                yield found

    return run


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, edit: float = EDIT, block: int = BLOCK) -> DataFrame:
    """doc_id, contaminated, item_ids (array), least_edits of every row of docs."""
    rows = docs.select(long_id(), F.col("text").cast("string").alias("text"), F.lit(None).cast("array<long>").alias("item_ids"), F.lit(None).cast("long").alias("least_edits"))
    for sent in item_blocks(spark, benchmark, edit, block):
        rows = rows.mapInArrow(searcher(sent), rows.schema)
    ids = F.sort_array(F.array_distinct(F.array_compact(F.coalesce("item_ids", F.array().cast("array<long>")))))
    return rows.select("doc_id", F.col("least_edits").isNotNull().alias("contaminated"), ids.alias("item_ids"), "least_edits")


def searcher(sent):
    find = finder(sent)

    @forgetting
    def run(batches):
        for b in batches:
            found, least = [], []
            for hits, ids, low in zip(find(b.column("text")), b.column("item_ids").to_pylist(), b.column("least_edits").to_pylist(), strict=True):
                found.append((ids or []) + list(hits))
                least.append(min([*hits.values(), *([low] if low is not None else [])], default=None))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(found, pa.list_(pa.int64())), pa.array(least, pa.int64())], ["doc_id", "text", "item_ids", "least_edits"])

    return run


def uncontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, edit: float = EDIT, block: int = BLOCK) -> DataFrame:
    """The rows of docs, whatever their ids, that leak no item. Only texts go to Python."""
    for sent in item_blocks(spark, benchmark, edit, block):
        docs = docs.filter(~F.arrow_udf(leaky(sent), "boolean")(F.col("text").cast("string")))
    return docs


def leaky(sent):
    find = finder(sent)

    @forgetting
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in texts:
            yield pa.array([bool(h) for h in find(a)], pa.bool_())

    return run


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL: dict[str, str] = {}
