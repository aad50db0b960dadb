"""Exact token counts with overlap resynchronisation for huge documents.

A text of up to `chunk` characters is encoded at once. A longer one is encoded in chunks that overlap, with offsets.
Two neighbours are spliced at a place in their overlap where both have a token boundary that is proven stable: no
piece of the vocabulary holds the two characters around it next to each other, so no merge can ever cross it, and what
lies left and right of it is encoded alike in the chunks and in the whole text. If an overlap has no such place it is
widened, in the end to the whole rest of the text, so the count is always that of the whole text.

Defined results: null counts as empty (0 bytes, 0 tokens); repeated rows give repeated rows; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import long_id, ship, table

CHUNK, OVERLAP, LIMIT = 16_384, 256, 4096
TOKENIZER = "piece_bpe_32k.model"
SPACE = "▁"


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine; a path is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Counts tokens of one sentencepiece model."""

    def __init__(self, model: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(model))
        self.chunk, self.overlap = chunk, overlap
        self.inside: set[str] = set()
        #: Characters that a token stands for; a byte that continues a character has none.
        self.width = np.ones(self.model.get_piece_size(), np.int64)
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.width[i] = not 0x80 <= int(piece[3:5], 16) <= 0xBF
            elif not self.model.is_control(i):
                self.width[i] = len(piece)
                self.inside.update(map(str.__add__, piece, piece[1:]))
        self.widened = 0

    def stable(self, text: str, at: int) -> bool:
        """No piece holds the characters on both sides of `at`, so no merge crosses it."""
        return 0 < at < len(text) and (text[at - 1] + text[at]).replace(" ", SPACE) not in self.inside

    def begins(self, text: str, offset: int) -> np.ndarray | None:
        """Where each token begins; None if the model doesn't keep the characters, so that there is nothing to splice at."""
        ids = np.array(self.model.encode(text), np.int64)
        width = self.width[ids]
        after = np.cumsum(width)
        if not len(ids) or after[-1] != len(text) + 1:  # one space is put before a text
            return None
        return offset + np.maximum(after - np.maximum(width, 1) - 1, 0)

    def count(self, text: str) -> int:
        if len(text) <= self.chunk:
            return len(self.model.encode(text))
        total, start, since = 0, 0, 0
        end = min(len(text), self.chunk)
        left = self.begins(text[:end], 0)
        while left is not None:
            if end == len(text):
                return total + int((left >= since).sum())
            width, cut = self.overlap, None
            while cut is None:
                begin = max(since, end - width)
                stop = min(len(text), end + self.chunk)
                right = self.begins(text[begin:stop], begin)
                if right is None:
                    return len(self.model.encode(text))
                # both ends of the overlap are cuts of ours, so they prove nothing
                cut = next((b for b in np.intersect1d(left, right)[::-1].tolist() if begin < b < end and self.stable(text, b)), None)
                if cut is None:
                    self.widened += 1
                    if begin == since:  # nothing in all of this chunk: take a larger one
                        end = min(len(text), end + max(self.chunk, end - start))
                        left = self.begins(text[start:end], start)
                        if left is None or end == len(text):
                            break
                    width *= 2
            if cut is not None:
                total += int(((since <= left) & (left < cut)).sum())
                start, end, since, left = begin, stop, cut, right
        return len(self.model.encode(text))

    def counts(self, texts: list[str]) -> list[int]:
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk]
        out = [0] * len(texts)
        for i, ids in zip(short, self.model.encode([texts[i] for i in short], num_threads=1), strict=True):
            out[i] = len(ids)
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                out[i] = self.count(t)
        return out


@cache
def counter(model: str, chunk: int, overlap: int) -> Counter:
    return Counter(model, chunk, overlap)


def token_counts(spark: SparkSession, docs: DataFrame, model: str = TOKENIZER, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs."""
    ship(spark)

    def run(batches):
        c = counter(model, chunk, overlap)
        for b in batches:
            n = []
            column = b.column("text")
            for at in range(0, len(column), 256):
                n += c.counts(column.slice(at, 256).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(long_id(), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
