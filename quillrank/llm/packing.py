"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become token ids once; only lengths travel on. Pieces are dealt by hash to blocks of bounded size. On every
block some islands each evolve a few packings: a child takes whole well-filled bins of one parent, drops the bins of
the other that share a piece with them, and the displaced pieces go back by best fit. Between epochs the best packing
of each island migrates to the next one; the best island's packing counts. An island stops when it has reached the
lower bound. Badly filled bins of many blocks then meet in one more block of their own.

Defined results: null text is empty and becomes the single end token; repeated rows are documents of their own; null
ids stay null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left, insort
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, long_id, table
from .token_counts import tokenizer_path

TOKENIZER, CAPACITY, END = "word_bpe_49k.json", 2048, 0
BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 8192, 2, 2, 6, 3
#: Words whose ids a worker remembers before it forgets them all.
CACHED = 600_000

# Up to U+017F without U+0130, Python's and the library's classes agree and NFC changes nothing; other texts go to the library whole.
ODD = re.compile("[^\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u017f]|<\\|")
LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f"
DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^\\s{LETTER}{DIGIT}]+")


class Encoder(dict):
    """Texts -> little-endian 32-bit ids, as the library gives them; ids of words are remembered."""

    def __init__(self, model: str, cached: int = CACHED):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model, self.cached = Tokenizer.from_file(tokenizer_path(model)), cached
        self.by_word = '"end_of_word_suffix":"</w>"' in self.model.to_str()
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        for piece, i in self.model.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = np.array(self.model.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return ids

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.cached:
            self.clear()
            new = list(words)
        if not new:
            return
        # one text of all new words, cut after each token that ends a word
        ids = np.array(self.model.encode(" ".join(new), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(new):
            raise ValueError("the vocabulary doesn't mark the ends of words")
        raw, at = ids.tobytes(), 0
        for w, end in zip(new, (4 * ends).tolist(), strict=True):
            self[w] = raw[at:end]
            at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [WORD.findall(t.lower()) if self.by_word and not ODD.search(t) else None for t in texts]
        self.learn({w for words in split if words for w in words})
        get = self.__getitem__
        return [b"".join(map(get, words)) if words is not None else np.array(self.model.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t, words in zip(texts, split, strict=True)]


@cache
def encoder(model: str, cached: int = CACHED) -> Encoder:
    return Encoder(model, cached)


def pieces_of(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids with the end token."""
    ids += END.to_bytes(4, "little")
    step = 4 * capacity
    return [(i, i * capacity, len(ids[at : at + step]) // 4, zlib.crc32(ids[at : at + step])) for i, at in enumerate(range(0, len(ids), step))]


class Bins:
    """Bins of pieces with best-fit insertion: the fullest bin that still has room takes a piece."""

    def __init__(self, lengths, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []
        self.open: list[tuple[int, int]] = []

    def add_bin(self, items: list[int]) -> None:
        room = self.capacity - int(sum(self.lengths[i] for i in items))
        self.bins.append(list(items))
        self.free.append(room)
        if room:
            insort(self.open, (room, len(self.bins) - 1))

    def insert(self, items) -> None:
        for i in items:
            need = self.lengths[i]
            at = bisect_left(self.open, (need, -1))
            if at == len(self.open):
                self.add_bin([i])
            else:
                room, b = self.open.pop(at)
                self.bins[b].append(i)
                self.free[b] = room - need
                if room > need:
                    insort(self.open, (room - need, b))

    def fitness(self) -> float:
        return sum((1 - f / self.capacity) ** 2 for f in self.free) / max(1, len(self.free))


def by_length(items, lengths):
    return sorted(items, key=lambda i: -lengths[i])


def tightened(bins: list[list[int]], loose: list[int], lengths, capacity: int) -> list[int]:
    """Swaps one or two pieces of a bin for a loose one that fills it better; what is loose then is smaller."""
    order = sorted((lengths[i], i) for i in loose)
    for items in bins:
        room, best = capacity - sum(lengths[i] for i in items), (0, None, 0)
        if not room or not order or len(items) > 12:
            continue
        for k, x in enumerate(items):
            for out in [(x,), *((x, y) for y in items[k + 1 :])]:
                size = sum(lengths[i] for i in out)
                at = bisect_left(order, (size + room + 1, -1)) - 1
                if at >= 0 and order[at][0] - size > best[0]:
                    best = (order[at][0] - size, out, at)
        if best[1]:
            _, piece = order.pop(best[2])
            for x in best[1]:
                items.remove(x)
                insort(order, (lengths[x], x))
            items.append(piece)
    return [i for _, i in order]


def crossover(a: Bins, b: Bins, rng: random.Random) -> Bins:
    """b's well-filled bins as they are and a's bins that share no piece with them; pieces without a bin are swapped in
    where they fill a bin better, and the rest goes by best fit."""
    full = [x for x, f in zip(b.bins, b.free, strict=True) if f <= b.capacity // 64 and rng.random() < 0.5]
    taken = {i for x in full for i in x}
    child = Bins(a.lengths, a.capacity)
    displaced, kept = [], []
    for x in full:
        child.add_bin(x)
    worst = set(sorted(range(len(a.bins)), key=lambda k: -a.free[k])[: max(2, len(a.bins) // 20)])
    for k, x in enumerate(a.bins):
        if k in worst or not taken.isdisjoint(x):
            displaced += [i for i in x if i not in taken]
        else:
            kept.append(list(x))
    displaced = tightened(kept, displaced, a.lengths, a.capacity)
    for x in kept:
        child.add_bin(x)
    child.insert(by_length(displaced, a.lengths))
    return child


def evolve(lengths: list[int], seed: int, capacity: int = CAPACITY, migrants: list[list[list[int]]] = (), generations: int = GENERATIONS, population: int = POPULATION) -> Bins:
    """The best packing of pieces of these lengths (each at most the capacity) that one island finds."""
    rng = random.Random(seed)
    least = -(-sum(lengths) // capacity)
    full = [i for i, n in enumerate(lengths) if n == capacity]
    rest = [i for i, n in enumerate(lengths) if n < capacity]

    def packed(order, bins=()) -> Bins:
        p = Bins(lengths, capacity)
        for x in bins:
            p.add_bin(x)
        p.insert(order)
        return p

    alive = [packed([], m) for m in migrants] or [packed(by_length(rest, lengths), [[i] for i in full])]
    while len(alive) < population and min(len(p.bins) for p in alive) > least:
        order = sorted(rest, key=lambda i: -lengths[i] * rng.uniform(0.8, 1.0))
        alive.append(packed(order, [[i] for i in full]))
    for _ in range(generations):
        if min(len(p.bins) for p in alive) <= least:
            break
        a, b = rng.sample(alive, 2)
        alive.append(crossover(a, b, rng))
        alive = sorted(alive, key=lambda p: (len(p.bins), -p.fitness()))[:population]
    return min(alive, key=lambda p: (len(p.bins), -p.fitness()))


def solution(found: Bins, pids, block: int, island: int) -> pd.DataFrame:
    rows = []
    for k, items in enumerate(found.bins):
        at = 0
        for i in items:
            rows.append((pids[i], k, at, found.free[k]))
            at += found.lengths[i]
    out = pd.DataFrame(rows, columns=["pid", "bin", "offset", "room"])
    return out.assign(block=block, island=island, bins=len(found.bins))[["block", "island", "pid", "bin", "offset", "room", "bins"]]


PLACED = "block long, island int, pid long, bin long, offset long, room long, bins long"


def first_epoch(capacity: int, salt: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid")
        return solution(evolve(pdf["length"].tolist(), hash((*map(int, key), salt)), capacity), pdf["pid"].tolist(), *map(int, key))

    return run


def next_epoch(capacity: int, salt: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["origin"] == pdf["origin"].min()].sort_values("pid")
        pids, lengths = own["pid"].tolist(), own["length"].tolist()
        at = {p: i for i, p in enumerate(pids)}
        migrants = [[[at[p] for p in x] for x in part.groupby("bin")["pid"].agg(list)] for _, part in pdf.groupby("origin")]
        return solution(evolve(lengths, hash((*map(int, key), salt)), capacity, migrants), pids, *map(int, key))

    return run


def pack_lengths(scratch: Scratch, items: DataFrame, tag: str, capacity: int, islands: int, epochs: int) -> DataFrame:
    """items (pid, length, block) -> the best island's (block, pid, bin, offset, room) of each block."""
    spread = items.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    found = scratch.keep(spread.groupBy("block", "island").applyInPandas(first_epoch(capacity, 0), PLACED), f"{tag}-0")
    for e in range(1, epochs):
        # blocks that have reached the lower bound are done; in the others each island meets the elite of the one before it
        least = items.groupBy("block").agg(F.ceil(F.sum("length") / capacity).alias("least"))
        best = found.groupBy("block").agg(F.min("bins").alias("now")).join(least, "block").filter("now > least").select("block")
        todo = found.join(best, "block", "left_semi")
        both = todo.withColumn("origin", F.col("island")).unionByName(todo.withColumn("origin", F.col("island")).withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands))))
        again = both.join(items.select("pid", "length"), "pid").groupBy("block", "island").applyInPandas(next_epoch(capacity, e), PLACED)
        found = scratch.keep(found.join(best, "block", "left_anti").unionByName(again), f"{tag}-{e}")
    top = found.groupBy("block").agg(F.min(F.struct("bins", "island")).alias("t")).select("block", F.col("t.island").alias("island"))
    return found.join(top, ["block", "island"]).select("block", "pid", "bin", "offset", "room")


def pack_documents(spark: SparkSession, docs: DataFrame, model: str = TOKENIZER, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, cached: int = CACHED) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs."""
    scratch = Scratch(spark, "pack")

    def tokenize(batches):
        e = encoder(model, cached)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                for doc, ids in zip(part.column("doc_id").to_pylist(), e.encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    for p in pieces_of(ids, capacity):
                        for col, x in zip(out, (doc, *p), strict=True):
                            col.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    cut = docs.select(long_id(), F.col("text").cast("string").alias("text")).mapInArrow(tokenize, "doc_id long, piece int, start long, length long, ids_crc32 long")
    cut = scratch.keep(cut.withColumn("pid", F.monotonically_increasing_id()), "pieces")
    n = cut.count()
    blocks = max(1, -(-n // block))
    items = cut.select("pid", "length", F.pmod(F.xxhash64("pid"), F.lit(blocks)).alias("block"))
    placed = scratch.keep(pack_lengths(scratch, items, "main", capacity, islands, epochs), "placed")
    # bins with much room are packed once more, their pieces dealt to blocks of the same size
    loose = placed.filter(F.col("room") > capacity // 32).select("pid")
    tails = max(1, -(-loose.count() // block))
    again = cut.select("pid", "length").join(loose, "pid").withColumn("block", F.pmod(F.xxhash64("pid", F.lit(1)), F.lit(tails)))
    tail = pack_lengths(scratch, again, "tail", capacity, 1, 1)
    wide = F.lit(1 << 32)
    whole = placed.filter(F.col("room") <= capacity // 32).select("pid", (F.col("block") * wide + F.col("bin") * 2).alias("sequence_id"), "offset").unionByName(tail.select("pid", (F.col("block") * wide + F.col("bin") * 2 + 1).alias("sequence_id"), "offset"))
    return cut.join(whole, "pid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
