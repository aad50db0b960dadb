"""Operators against brute force on texts that meet their harder paths: large buckets, hot groups, repeated ids, bounds."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from quillrank.llm import common, decontaminate, near_dup, packing, quality, sharding, substring_dedup, token_counts, toxicity

DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.01"


def vocabulary(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(n)]


def mutated(rng, words, vocab, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice(vocab)
    return out


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    pairs = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    links = 0
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            links += 1
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: root(i) for i in texts}, {i: len(s) for i, s in sets.items()}, links


@pytest.mark.parametrize("block", [near_dup.BLOCK, 8])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, block):
    """Families of copies with more and more changes; small blocks cut their buckets."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(41)
    vocab, texts = vocabulary(rng, 4000), {}
    for family in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice((8, 60, 150, 400)))]
        for k in range(rng.choice((2, 10, 40))):
            texts[len(texts)] = " ".join(mutated(rng, base, vocab, rng.randrange(0, 1 + len(base) // 40)))
    order = list(texts.items())
    rng.shuffle(order)
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(spark, spark.createDataFrame(order, DOCS)).collect()}
    want, sizes, links = brute_components(texts)
    assert links > 500 and len(set(want.values())) > 20
    assert {i: r["component_id"] for i, r in got.items()} == want and {i: r["n_shingles"] for i, r in got.items()} == sizes


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_near_duplicates_of_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want, _, links = brute_components({r["doc_id"]: r["text"] for r in docs.collect()})
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark, docs).collect()}
    assert links > 50 and got == want


@pytest.mark.parametrize("hot", [substring_dedup.HOT_WINDOWS, 500])
def test_substrings_of_texts_that_repeat_themselves(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "LONG", 70)
    rng = random.Random(43)
    vocab = vocabulary(rng, 500)
    passage = [rng.choice(vocab) for _ in range(90)]
    rows = [(0, " ".join(["a", "b"] * 800)), (1, " ".join(["a", "b"] * 300 + ["c"])), (2, " ".join(passage[:55] + ["x"])), (5, " ".join(["b", "a"] * 30)), (5, " ".join(["y"] + passage)), (7, " ".join(passage + passage))]
    rows += [(10 + i, " ".join([rng.choice(vocab) for _ in range(20)] + passage)) for i in range(20)]
    got = Counter(tuple(r) for r in substring_dedup.substring_dedup(spark, spark.createDataFrame(rows, DOCS), hot)[0].collect())
    least = {}
    for i, t in rows:
        w = t.split()
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            least[k] = min(i, least.get(k, i))
    want = Counter()
    for i, t in rows:
        w = t.split()
        out = [False] * len(w)
        for p in range(len(w) - 49):
            if least[tuple(w[p : p + 50])] < i:
                out[p : p + 50] = [True] * 50
        want[i, len(w), sum(out), hashlib.sha256(" ".join(x for x, o in zip(w, out, strict=True) if not o).encode()).hexdigest()] += 1
    assert got == want


#: Sizes for which best fit by length needs 11 bins where 9 do, forty times over.
HALF, QUARTER = 1024, 512
WORST = [HALF + 10] * 120 + [QUARTER + 20] * 120 + [QUARTER + 10] * 120 + [QUARTER - 20] * 240


def test_evolution_beats_best_fit():
    best_fit = packing.Bins(WORST, 2048)
    best_fit.insert(packing.by_length(range(len(WORST)), WORST))
    start = packing.evolve(WORST, 1, generations=0, population=6)
    found = packing.evolve(WORST, 1, generations=60, population=6)
    assert len(best_fit.bins) == 220 and len(found.bins) + 5 < len(start.bins) <= 201
    assert sorted(i for b in found.bins for i in b) == list(range(len(WORST))) and min(found.free) >= 0


def test_islands_meet_and_improve(spark):
    items = spark.createDataFrame([(i, n, 0) for i, n in enumerate(WORST)], "pid long, length long, block long")
    count = {}
    for epochs in (1, 4):
        rows = packing.pack_lengths(common.Scratch(spark, "test"), items, f"e{epochs}", 2048, 3, epochs).collect()
        assert sorted(r["pid"] for r in rows) == list(range(len(WORST)))
        assert max(Counter({b: sum(WORST[r["pid"]] for r in rows if r["bin"] == b) for b in {r["bin"] for r in rows}}).values()) <= 2048
        count[epochs] = len({r["bin"] for r in rows})
    assert count[4] < count[1] < 220  # elites of other islands help


def test_loose_bins_are_packed_in_bounded_blocks(spark):
    """Texts of more than half a sequence: every bin is loose, so all pieces come to the second packing."""
    docs = spark.createDataFrame([(i, "word " * (1100 + i % 7)) for i in range(60)], DOCS)
    rows = packing.pack_documents(spark, docs, block=16).collect()
    assert len({r["sequence_id"] for r in rows}) == 60 and all(r["offset"] == 0 for r in rows)


def test_every_leak_within_the_edits_is_found():
    """Windows with any number of edits up to the limit, found or not: at least 97 of 100, and all without edits."""
    rng = random.Random(47)
    vocab = vocabulary(rng, 20_000)
    for n in (10, 25, 60):
        k = decontaminate.most_edits(n, decontaminate.EDIT)
        plain = [[rng.choice(vocab) for _ in range(n)] for _ in range(30)]
        items = decontaminate.Items(list(range(30)), [" ".join(x) for x in plain], decontaminate.EDIT)
        docs = []
        for i, item in enumerate(plain):
            for edits in range(k + 1):
                words = list(item)
                for p in sorted(rng.sample(range(n), edits), reverse=True):
                    words[p : p + rng.randrange(2)] = [] if rng.random() < 0.4 else [f"new{rng.randrange(999)}"]
                docs.append((i, edits, [rng.choice(vocab) for _ in range(25)] + words + [rng.choice(vocab) for _ in range(25)]))
        hashes = [decontaminate.word_hashes(" ".join(w)) for _, _, w in docs]
        found, good, hit = decontaminate.leaks(items, hashes), 0, 0
        for (i, edits, _), words, leak in zip(docs, hashes, found, strict=True):
            least = decontaminate.edits_inside(items.words[i], words)
            assert least <= edits or edits == k  # an insertion beside a deletion may cost two
            if least <= k:
                good, hit = good + 1, hit + (i in leak)
                assert leak.get(i, least) == least and (least or i in leak)
        assert hit >= 0.97 * good


def test_one_id_many_times(spark):
    """What comes to the driver is bounded by ids, not by how often one comes."""
    rows = [(1, f"nasty words {i} here again. And more of them.") for i in range(10_000)] + [(i, f"clean text {i} with other words. More text.") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(1, 0), (1, 1), *[(i, 0) for i in range(2, 60)]], "doc_id long, toxic int")
    seen = []
    real = toxicity.nnpu
    try:
        toxicity.nnpu = lambda pos, unl, prior: seen.append((len(pos), len(unl))) or real(pos, unl, prior)
        assert toxicity.toxicity(spark, docs, labels).count() == len(rows)
    finally:
        toxicity.nnpu = real
    assert not seen or max(seen[0]) <= 60
    real, got = quality.logistic, []
    try:
        quality.logistic = lambda rows, soft: got.append(len(rows)) or real(rows, soft)
        assert quality.quality(spark, docs).count() == len(rows)
    finally:
        quality.logistic = real
    assert got == [59]


def test_clashing_labels_are_toxic(spark):
    docs = spark.createDataFrame([(i, "w" * (i % 5 + 1)) for i in range(40)], DOCS)
    twice = spark.createDataFrame([(i, v) for i in range(40) for v in (0, 1, 0)], "doc_id long, toxic int")
    once = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, toxic int")
    of = lambda lab: {r["doc_id"]: r["score"] for r in toxicity.toxicity(spark, docs, lab).collect()}
    assert of(twice) == of(once)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_toxicity_on_held_out_documents(spark):
    """Some 30 toxic documents train here; with ten times as many (sf0.1) 95 of 100 toxic ones are found."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = [(toxic[r["doc_id"]], r["predicted"], r["score"]) for r in toxicity.toxicity(spark, docs, labels).collect() if r["held_out"] and r["doc_id"] in toxic]
    hits = sum(t == p for t, p, _ in got)
    assert len(got) > 50 and hits >= 0.88 * len(got) and all(0 <= s <= 1 for _, _, s in got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_quality_on_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = [(good[r["doc_id"]], r["kept"]) for r in quality.quality(spark, docs).collect() if r["doc_id"] in good]
    assert sum(bool(a) == b for a, b in got) >= 0.95 * len(got)


def test_quality_posteriors_against_bayes():
    """The posterior of a pattern is Bayes' rule over the estimated accuracies, worked out vote by vote."""
    rng = np.random.default_rng(53)
    patterns = np.unique(rng.integers(-1, 2, (60, 4)), axis=0)
    counts = rng.integers(1, 50, len(patterns)).astype(float)
    post, told, prior = quality.expectation_maximisation(patterns, counts)
    for p, got in zip(patterns, post, strict=True):
        good, bad = prior, 1 - prior
        for j, v in enumerate(p):
            bad, good = bad * told[j, 0, v + 1], good * told[j, 1, v + 1]
        assert got == pytest.approx(good / (good + bad), abs=1e-6)


def cut_links(rows, shard_of):
    """Pairs of equal texts that are in different shards."""
    by = {}
    for i, t in rows:
        by.setdefault(t, Counter())[shard_of[i]] += 1
    return sum((sum(c.values()) ** 2 - sum(n * n for n in c.values())) // 2 for c in by.values())


def test_propagation_cuts_fewer_links_each_round(spark):
    rng = random.Random(59)
    rows = [(i, f"text {i}" if i % 3 else f"group {rng.randrange(120)}") for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    cut = {}
    for rounds in (0, 1, 3):
        got = sharding.shard(spark, docs, shards=10, rounds=rounds).collect()
        assert set(Counter(r["shard"] for r in got).values()) == {300}
        cut[rounds] = cut_links(rows, {r["doc_id"]: r["shard"] for r in got})
    hashed = cut_links(rows, {i: hash((i, 1)) % 10 for i, _ in rows})
    assert cut[3] <= cut[1] and cut[3] < 0.1 * hashed


def test_token_counts_through_spark(spark):
    rng = random.Random(61)
    parts = ["a", " ", "  ", "the ", "日本", "é", "\n", "==", "😀", "<s>", "▁", "000"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 3000))) for _ in range(40)] + [None, "", "word " * 50_000]
    model = token_counts.Counter(token_counts.TOKENIZER).model
    got = {r["doc_id"]: r for r in token_counts.token_counts(spark, spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert all((got[i]["n_tokens"], got[i]["n_bytes"]) == (len(model.encode(t or "")), len((t or "").encode())) for i, t in enumerate(texts))
    assert got[len(texts) - 1]["over_limit"] and not got[len(texts) - 2]["over_limit"]
