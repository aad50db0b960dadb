"""Removal of repeated 50-word windows by super-k-mer partitioning.

A window's minimiser is the smallest hash of its 10-word grams, so equal windows have equal minimisers. Consecutive
windows of one minimiser form a super-k-mer. Minimisers that only one document has cannot repeat and are let go after
one count; the super-k-mers of the others travel as packed strings to the bucket of their minimiser. Equal strings
collapse before that shuffle. In a bucket all windows are sorted by their words and the smallest document of each is
found; a bucket with too many windows is cut into chunks whose window counts are merged by a second aggregation. A
super-k-mer of many windows (a text that repeats itself) travels as several strings.

Defined results: null text has no words; rows with one id are documents of the same rank, neither smaller than the other,
and equal ones have equal results; null ids are kept whole and don't count as smaller; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, forgetting, grams, hashed, long_id, table, texts

WINDOW, GRAM = 50, 10
#: Windows that a bucket may have before it is cut, that a worker sorts at once, and that one string may hold; a window takes
#: 200 bytes there.
HOT_WINDOWS, SORT_WINDOWS, LONG, HOT_SENT = 100_000, 60_000, 2_000, 20_000


def minimisers(w: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Minimiser and first window of each super-k-mer of the hashed words; they follow one another without a gap."""
    g = grams(w, gram)
    span = window - gram + 1
    if len(w) < window:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    low = np.lib.stride_tricks.sliding_window_view(g, span)
    low = np.concatenate([low[i : i + 4096].min(axis=1) for i in range(0, len(low), 4096)])
    starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    return low[starts].view(np.int64), starts.astype(np.int32)


@forgetting
def split(batches):
    """Per document: words, the digest of all of them, and its super-k-mers."""
    for b in batches:
        n, sha, mins, starts = [], [], [], []
        for text in texts(b.column("text")):
            words = (text or b"").split()
            m, s = minimisers(hashed(words)) if len(words) >= WINDOW else (np.empty(0, np.int64), np.empty(0, np.int32))
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            mins.append(m)
            starts.append(s)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(n, pa.int64()), pa.array(sha), pa.array(mins, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int32()))], ["doc_id", "h", "n_words", "sha", "mins", "starts"])


def pack(batches):
    """The packed strings of the super-k-mers to compare: (doc_id, h, start, minimiser, sid, packed, windows)."""
    for b in batches:
        rows = zip(b.column("doc_id").to_pylist(), b.column("h").to_pylist(), texts(b.column("text")), b.column("runs").to_pylist(), strict=True)
        out: list[list] = [[] for _ in range(7)]
        for doc, h, text, runs in rows:
            words = text.split()
            for r in runs:
                for at in range(r["start"], r["start"] + r["windows"], LONG):
                    n = min(LONG, r["start"] + r["windows"] - at)
                    packed = b" ".join(words[at : at + n + WINDOW - 1])
                    for col, x in zip(out, (doc, h, at, r["minimiser"], xxhash.xxh3_128_digest(packed), packed, n), strict=True):
                        col.append(x)
            if len(out[0]) > 20_000:
                yield packed_batch(out)
                out = [[] for _ in range(7)]
        if out[0]:
            yield packed_batch(out)


def packed_batch(out):
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "h", "start", "minimiser", "sid", "packed", "windows"])


def window_rows(strings: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the strings as rows of word numbers, compared exactly, and the string that each is of."""
    numbers: dict[bytes, int] = {}
    rows, of = [], []
    for i, words in enumerate(strings):
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int32, count=len(words))
        v = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
        rows.append(v)
        of.append(np.full(len(v), i, np.int64))
    return np.ascontiguousarray(np.concatenate(rows)), np.concatenate(of)


def smallest(strings: list[list[bytes]], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the strings, the smallest document among equal windows; and the string it is of. Sorts them."""
    rows, of = window_rows(strings)
    keys = rows.view(np.dtype((np.void, rows.shape[1] * 4))).ravel()
    order = np.argsort(keys, kind="stable")
    same = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    first = np.flatnonzero(same)
    low = np.minimum.reduceat(docs[of][order], first)
    out = np.empty(len(order), np.int64)
    out[order] = low[np.cumsum(same) - 1]
    return out, of


def settle(batches):
    """Rows (sid, minimiser, packed, doc) sorted by minimiser -> (sid, low): the smallest document of every window of the string."""
    sids, docs, strings, last, windows = [], [], [], None, 0
    for b in batches:
        for sid, m, packed, doc in zip(b.column("sid").to_pylist(), b.column("minimiser").to_pylist(), b.column("packed").to_pylist(), b.column("doc").to_pylist(), strict=True):
            if m != last and windows >= SORT_WINDOWS:
                yield settled(sids, docs, strings)
                sids, docs, strings, windows = [], [], [], 0
            last = m
            words = packed.split(b" ")
            sids.append(sid)
            docs.append(doc)
            strings.append(words)
            windows += len(words) - WINDOW + 1
    if sids:
        yield settled(sids, docs, strings)


def settled(sids, docs, strings):
    low, of = smallest(strings, np.array(docs, np.int64))
    cuts = np.flatnonzero(np.diff(of)) + 1
    return pa.RecordBatch.from_arrays([pa.array(sids, pa.binary()), pa.array(np.split(low, cuts), pa.list_(pa.int64()))], ["sid", "low"])


def chunk(batches):
    """Strings of cut buckets -> a row for each distinct window of some strings: (window, doc, n), n how often it stands there."""
    best: dict[bytes, list[int]] = {}

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(list(best), pa.binary()), *(pa.array([x[k] for x in best.values()], pa.int64()) for k in (0, 1))], ["window", "doc", "n"])

    for b in batches:
        for packed, doc in zip(b.column("packed").to_pylist(), b.column("doc").to_pylist(), strict=True):
            for w in windows_of(packed):
                x = best.setdefault(w, [doc, 0])
                x[0], x[1] = min(x[0], doc), x[1] + 1
            if len(best) >= SORT_WINDOWS:
                yield rows()
                best.clear()
    yield rows()


def windows_of(packed: bytes) -> list[bytes]:
    words = packed.split(b" ")
    return [hashlib.sha256(b" ".join(words[i : i + WINDOW])).digest() for i in range(len(words) - WINDOW + 1)]


def spread(batches):
    sids, at, ws = [], [], []

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(sids, pa.binary()), pa.array(at, pa.int32()), pa.array(ws, pa.binary())], ["sid", "at", "window"])

    for b in batches:
        for sid, packed in zip(b.column("sid").to_pylist(), b.column("packed").to_pylist(), strict=True):
            found = windows_of(packed)
            sids += [sid] * len(found)
            at += range(len(found))
            ws += found
            if len(ws) >= SORT_WINDOWS:
                yield rows()
                sids, at, ws = [], [], []
    yield rows()


def rewrite(batches):
    """Texts with their covered spans -> (doc_id, n_removed, kept_sha256, kept)."""
    for b in batches:
        removed, sha, kept = [], [], []
        for text, found in zip(texts(b.column("text")), b.column("found").to_pylist(), strict=True):
            words = text.split()
            edge = np.zeros(len(words) + 1, np.int64)
            for f in found:
                at = np.array(f["offsets"], np.int64) + f["start"]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WINDOW, -1)
            out = np.cumsum(edge)[:-1] > 0
            rest = b" ".join([words[i] for i in np.flatnonzero(~out)])
            removed.append(int(out.sum()))
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(removed, pa.int64()), pa.array(sha), pa.array(kept)], ["doc_id", "h", "n_removed", "kept_sha256", "kept_text"])


def substring_dedup(spark: SparkSession, docs: DataFrame, hot_windows: int = HOT_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """(digests, changed): doc_id, n_words, n_removed, kept_sha256 of every row, and the new text of each document that loses words."""
    scratch = Scratch(spark, "substr")
    text = F.col("text").cast("string")
    source = docs.select(long_id(), text.alias("text"), F.xxhash64(text).alias("h"))  # h tells texts of one id apart
    prof = scratch.keep(source.mapInArrow(split, "doc_id long, h long, n_words long, sha string, mins array<long>, starts array<int>"), "profile")

    each = prof.filter("doc_id is not null").select("doc_id", "h", "n_words", F.explode(F.arrays_zip("mins", "starts", F.slice(F.concat("starts", F.array((F.col("n_words") - (WINDOW - 1)).cast("int"))), F.lit(2), F.size("starts")).alias("ends"))).alias("r"))
    runs = each.select("doc_id", "h", F.col("r.mins").alias("minimiser"), F.col("r.starts").alias("start"), (F.col("r.ends") - F.col("r.starts")).alias("windows"))
    shared = runs.groupBy("minimiser").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo <> hi").select("minimiser")
    affected = runs.join(shared, "minimiser").groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "windows", "minimiser")).alias("runs"))  # a set, as rows may repeat
    affected = scratch.keep(source.join(affected, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]), "affected")

    packed = affected.mapInArrow(pack, "doc_id long, h long, start int, minimiser long, sid binary, packed binary, windows long")
    strings = scratch.keep(packed.groupBy("sid", "minimiser", "packed").agg(F.min("doc_id").alias("doc"), F.max("windows").alias("windows")), "strings")
    places = scratch.keep(packed.select("doc_id", "h", "start", "sid"), "places")
    hot = strings.groupBy("minimiser").agg(F.sum("windows").alias("n")).filter(F.col("n") > hot_windows).select("minimiser")
    hot = scratch.keep(hot, "hot")
    cols = ["sid", "minimiser", "packed", "doc"]
    if hot.isEmpty():
        calm = strings
    else:
        calm = strings.join(hot, "minimiser", "left_anti")
    low = calm.select(*cols).repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(settle, "sid binary, low array<long>")
    if not hot.isEmpty():
        cut = strings.join(hot, "minimiser", "left_semi")
        of_window = cut.select("packed", "doc").mapInArrow(chunk, "window binary, doc long, n long").groupBy("window").agg(F.min("doc").alias("doc"), F.sum("n").alias("n"))
        of_window = scratch.keep(of_window, "windows")
        # fewer than HOT_SENT windows can stand in more than a HOT_SENT-th of all places; they go to all tasks
        most = max(1000, (of_window.agg(F.sum("n")).first()[0] or 0) // HOT_SENT)
        often, seldom = F.broadcast(of_window.filter(F.col("n") > most)), of_window.filter(F.col("n") <= most)
        each = cut.select("sid", "packed").mapInArrow(spread, "sid binary, at int, window binary").join(often.withColumnRenamed("doc", "of_hot").drop("n"), "window", "left")
        parts = each.filter("of_hot is not null").select("sid", "at", F.col("of_hot").alias("doc")).unionByName(each.filter("of_hot is null").select("sid", "at", "window").join(seldom, "window").select("sid", "at", "doc"))
        merged = parts.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("at", "doc"))).alias("l")).select("sid", F.transform("l", lambda x: x["doc"]).alias("low"))
        low = low.unionByName(merged)
    low = scratch.keep(low, "low")

    repeated = places.join(low.filter(F.size("low") > 0), "sid").select("doc_id", "h", "start", F.expr("filter(transform(low, (x, i) -> if(x < doc_id, i, -1)), i -> i >= 0)").alias("offsets")).filter(F.size("offsets") > 0)
    found = repeated.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "offsets")).alias("found"))
    changed = scratch.keep(affected.select("doc_id", "h", "text").join(found, ["doc_id", "h"]).mapInArrow(rewrite, "doc_id long, h long, n_removed long, kept_sha256 string, kept_text string"), "changed")
    out = prof.select("doc_id", "h", "n_words", "sha").join(changed.select("doc_id", "h", "n_removed", "kept_sha256"), ["doc_id", "h"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")), changed


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark, table(spark, sf_dir, "documents"))[0]


SQL = {
    "op8_substring_dedup": """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i, hash(array_to_string(w[i:i+49], ' ')) AS g, md5(array_to_string(w[i:i+49], ' ')) AS m FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
f AS (SELECT doc_id, list(i) AS places FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g, m) AS least FROM p) WHERE least < doc_id GROUP BY 1),
o AS (SELECT f.doc_id, list_distinct(flatten(list_transform(places, lambda i: range(i, i + 50)))) AS gone FROM f),
k AS (SELECT doc_id, list(x ORDER BY i) AS kept FROM (SELECT w.doc_id, unnest(w.w) AS x, generate_subscripts(w.w, 1) AS i, coalesce(gone, []) AS gone FROM w JOIN o USING (doc_id)) WHERE NOT list_contains(gone, i) GROUP BY 1)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(len(o.gone), 0)::BIGINT AS n_removed, sha256(array_to_string(CASE WHEN o.gone IS NULL THEN w.w ELSE coalesce(k.kept, []) END, ' ')) AS kept_sha256
FROM w LEFT JOIN o USING (doc_id) LEFT JOIN k USING (doc_id)
"""
}
