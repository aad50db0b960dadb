"""Corpus operators against brute force on small fixtures."""

import hashlib
import random

import numpy as np
import pytest

from quillrank.llm import decontaminate, exact_dedup, near_dup, packing, sharding, substring_dedup, token_counts, toxicity

SCHEMA = "doc_id long, text string, score double"


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    base = words(rng, 200)
    near = base[:100] + ["x"] + base[101:]
    passage = words(rng, 80)
    texts = [None, "", " ", "one two", "One  two", " ".join(base), " ".join(base), " ".join(near), " ".join(words(rng, 60) + passage), " ".join(passage + words(rng, 70)), " ".join(words(rng, 9000))]
    return [(i, t, 0.5) for i, t in enumerate(texts)]


@pytest.mark.parametrize("sent", [exact_dedup.SENT, 4, 1])
def test_exact_dedup(spark, rows, sent):
    rows = rows + [(100 + i, "copied", 0.5) for i in range(30)]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(spark, spark.createDataFrame(rows, SCHEMA), sent=sent).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        same = [j for j, u, _ in rows if (u or "") == (t or "")]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(same), len(same), i == max(same))
        assert got[i]["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_near_duplicates(spark, rows):
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    sets = {i: set(near_dup.shingle_set(None if t is None else t.encode()).tolist()) for i, t, _ in rows}
    assert [got[i]["n_shingles"] for i in range(len(rows))] == [len(sets[i]) for i in range(len(rows))]
    assert got[4]["component_id"] == 3 and got[6]["component_id"] == got[7]["component_id"] == 5
    assert all(got[i]["component_id"] == i for i in (0, 1, 2, 3, 5, 8, 9, 10))


@pytest.mark.parametrize("hot", [100_000, 0])
def test_substring_dedup(spark, rows, hot):
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(spark, spark.createDataFrame(rows, SCHEMA), hot)[0].collect()}
    seen = set()
    for i, t, _ in rows:
        w = (t or "").split()
        out, own = [False] * len(w), set()
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            own.add(k)
            if k in seen:
                out[p : p + 50] = [True] * 50
        seen |= own
        kept = " ".join(x for x, o in zip(w, out, strict=True) if not o)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), sum(out), hashlib.sha256(kept.encode()).hexdigest())


def test_shards(spark, rows):
    got = sharding.shard(spark, spark.createDataFrame(rows, SCHEMA), shards=3).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(rows) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_packing(spark, rows):
    got = packing.pack_documents(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in rows}
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-sum(r["length"] for r in got) // 2048)


def test_word_cache_equals_the_library():
    e, rng = packing.encoder(packing.TOKENIZER), random.Random(2)
    parts = ["'s", "'LL", "É", "ß", "İ", "ſ", "²", "...", "<|endoftext|>", " ", "\n", "\x1c", "\xa0", "日", "x", "ŉ", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(300)]
    assert e.encode(texts) == [np.array(e.model.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_token_counts_resynchronise():
    c, rng = token_counts.Counter(token_counts.TOKENIZER, 300, 16), random.Random(3)
    parts = ["a", " ", "  ", "the ", "日本", "é", "\n", "==", "😀", "<s>", "▁", "000"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(200, 1500))) for _ in range(40)] + ["a" * 3000, " " * 2000, "日" * 2000]
    assert [c.count(t) for t in texts] == [len(c.model.encode(t)) for t in texts]


def test_leaks_by_edit_distance():
    rng = random.Random(4)
    item = words(rng, 30)
    items = decontaminate.Items([7], [" ".join(item)], 0.2)
    hit = words(rng, 40) + item[:10] + ["new"] + item[11:] + words(rng, 40)
    docs = [decontaminate.word_hashes(" ".join(x)) for x in (hit, words(rng, 100), item[:15])]
    assert decontaminate.leaks(items, docs) == [{0: 1}, {}, {}]


def test_toxicity(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(words(rng, 50) + (["nasty"] * 2 if i % 5 == 0 else [])), 0.0) for i in range(400)]
    labels = [(i, int(i % 5 == 0)) for i in range(0, 400, 2)]
    got = toxicity.toxicity(spark, spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    right = sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in got)
    assert right >= 390


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_dedup(spark, none).count() == 0
    assert near_dup.near_duplicates(spark, none).count() == 0
    assert substring_dedup.substring_dedup(spark, none)[0].count() == 0
    assert sharding.shard(spark, none).count() == 0
    assert packing.pack_documents(spark, none).count() == 0
