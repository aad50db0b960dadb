"""The whole pipeline against brute force on a small fixture."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

TOXIC = ["nasty", "vile", "foul"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs = {i: some(60) for i in range(400)}
    for i in range(0, 400, 5):
        docs[i] += TOXIC
        rng.shuffle(docs[i])
    items = {1: some(30), 2: some(24)}
    docs[101] = docs[102] = docs[1]  # exact copies
    docs[111] = [*docs[6][:-1], "changed"]  # near copies, in a chain
    docs[112] = ["other", *docs[111][1:]]
    docs[121] = some(40) + items[1] + some(40)
    docs[122] = some(40) + items[1][:8] + ["new"] + items[1][9:20] + items[1][21:] + some(9)
    docs[123] = some(9) + items[1][:18] + some(30)  # too little of an item
    docs[124] = some(5000)
    rows = [(i, " ".join(w), "en", "s", len(" ".join(w))) for i, w in docs.items()] + [(400, None, None, None, None), (401, "", "en", "s", 0)]
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), {r[0]: r[1] or "" for r in rows}, items


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def fewest_edits(item, words):
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_pipeline_against_brute_force(spark, tables):
    where, texts, items = tables
    got = corpus_pipeline.run(spark, where).collect()

    left = {i: t for i, t in texts.items() if not set(TOXIC) & set(t.split())}
    best = {}
    for i, t in left.items():
        best[t] = max(i, best.get(t, i))
    left = {i: t for i, t in left.items() if best[t] == i}
    sets = {i: shingles(t) for i, t in left.items()}
    component = {i: i for i in left}
    changed = True
    while changed:
        changed = False
        for a in left:
            for b in left:
                common = len(sets[a] & sets[b])
                if common and 100 * common >= 85 * len(sets[a] | sets[b]) and component[b] < component[a]:
                    component[a], changed = component[b], True
    left = {i: t for i, t in left.items() if component[i] == i}
    assert {101, 1, 111, 112}.isdisjoint(left) and {6, 102, 123, 401} <= set(left)
    words = {i: re.findall(r"[^\W_]+", t.lower()) for i, t in left.items()}
    left = {i: t for i, t in left.items() if not any(words[i] and fewest_edits(x, words[i]) <= len(x) // 5 for x in items.values())}
    assert {121, 122}.isdisjoint(left) and 123 in left

    assert {r["doc_id"] for r in got} == set(left)
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, t in left.items():
        ids = np.array([*model.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want = [(k, 2048 * k, len(ids[2048 * k :][:2048]), zlib.crc32(ids[2048 * k :][:2048].tobytes())) for k in range(-(-len(ids) // 2048))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[i]) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        ends = [o + n for o, n in sorted(b)]
        assert [o for o, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(bins) <= 1 - -sum(r["length"] for r in got) // 2048


def test_stages_keep_the_columns(spark, tables):
    where, _, _ = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, where).columns == docs.columns


def test_stages_on_no_documents(spark, tables):
    where, _, _ = tables
    docs = spark.read.parquet(f"{where}/documents.parquet").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, where).count() == 0
