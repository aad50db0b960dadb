"""Nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables, for every operator."""

import random
from collections import Counter

import numpy as np
import pytest

from quillrank.llm import decontaminate, exact_dedup, html_extract, near_dup, packing, quality, sharding, substring_dedup, token_counts, toxicity

#: Column names that the operators use themselves.
CLASH = "id long, n long, size long, label int, digest string, bands string, pid long, block int, rank long, component long, score double, pattern string, minimiser long"
DOCS = f"doc_id long, text string, {CLASH}"
LABELS = f"doc_id long, toxic int, {CLASH}"
ITEMS = f"item_id long, text string, {CLASH}"
NONE = (None,) * len(CLASH.split(","))


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(9)
    long_text = words(rng, 30_000)
    rows = [(None, "no id at all"), (None, None), (0, None), (1, ""), (2, " \n "), (3, "a b"), (3, "a b"), (4, long_text), (5, long_text), (6, words(rng, 80)), (7, words(rng, 80)), (8, "x" * 100_000)]
    docs = spark.createDataFrame([(*r, *NONE) for r in rows], DOCS)
    labels = spark.createDataFrame([(i, v, *NONE) for i, v in [(None, 1), (3, None), (4, 0), (5, 1), (6, 0), (7, 1), (7, 1), (99, 1)]], LABELS)
    items = spark.createDataFrame([(i, t, *NONE) for i, t in [(None, "no id"), (1, None), (2, ""), (3, long_text[3000:3300])]], ITEMS)
    return rows, docs, labels, items


PER_DOCUMENT = {
    "quality": lambda s, d, lab, it: quality.quality(s, d),
    "contamination": lambda s, d, lab, it: decontaminate.contamination(s, d, it),
    "toxicity": toxicity.toxicity,
    "shards": lambda s, d, lab, it: sharding.shard(s, d, shards=3),
    "token_counts": lambda s, d, lab, it: token_counts.token_counts(s, d),
    "substring": lambda s, d, lab, it: substring_dedup.substring_dedup(s, d)[0],
    "exact": lambda s, d, lab, it: exact_dedup.exact_dedup(s, d),
    "near": lambda s, d, lab, it: near_dup.near_duplicates(s, d),
}


def run(name, spark, docs, labels, items):
    op = PER_DOCUMENT[name]
    return op(spark, docs, labels) if name == "toxicity" else op(spark, docs, labels, items)


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_per_row(spark, cases, name):
    rows, docs, labels, items = cases
    got = run(name, spark, docs, labels, items).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    # repeated rows of one id have one result, but for the place in a shard
    if name != "shards":
        assert len({tuple(map(str, r)) for r in got if r["doc_id"] == 3}) == 1


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_empty(spark, cases, name):
    _, docs, labels, items = cases
    none = docs.filter("doc_id < -1")
    assert run(name, spark, none, labels, items).count() == 0
    assert run(name, spark, none, labels.filter("false"), items.filter("false")).count() == 0


def test_stated_results(spark, cases):
    rows, docs, labels, items = cases
    of = lambda name: {r["doc_id"]: r for r in run(name, spark, docs, labels, items).collect() if r["doc_id"] is not None}
    q, c, n, x, t, s = (of(k) for k in ("quality", "contamination", "near", "exact", "token_counts", "substring"))
    assert all(q[i]["score"] == 0 and not q[i]["kept"] for i in (0, 1, 2))
    assert {i for i in c if c[i]["contaminated"]} == {4, 5} and c[4]["item_ids"] == [3]
    assert [n[i]["component_id"] for i in range(9)] == [0, 1, 2, 3, 4, 4, 6, 7, 8]
    assert [n[i]["n_shingles"] for i in (0, 1, 2, 3, 8)] == [0, 0, 0, 1, 1]
    assert (x[0]["keep_id"], x[1]["keep_id"], x[3]["group_size"], x[4]["keep_id"]) == (1, 1, 2, 5)
    assert (t[0]["n_bytes"], t[0]["n_tokens"], t[4]["over_limit"]) == (0, 0, True)
    assert s[5]["n_removed"] == s[5]["n_words"] == 30_000 and s[4]["n_removed"] == s[6]["n_removed"] == 0


def test_items_without_id_are_searched(spark, cases):
    _, docs, labels, items = cases
    got = run("contamination", spark, docs, labels, items).filter("doc_id is null").collect()
    assert sorted((r["contaminated"], r["item_ids"], r["least_edits"]) for r in got if r["contaminated"]) == [(True, [], 0)]
    named = spark.createDataFrame([(1, "x one two three y"), (2, "four five")], "doc_id long, text string")
    both = spark.createDataFrame([(None, "one two"), (8, "two three"), (None, None)], "item_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["item_ids"]) for r in decontaminate.contamination(spark, named, both, block=1).collect()}
    assert got == {1: (True, [8]), 2: (False, [])}


def test_without_labels(spark, cases):
    _, docs, labels, _ = cases
    got = toxicity.toxicity(spark, docs, labels.filter("false")).collect()
    assert all(0 <= r["score"] < 1e-9 and r["predicted"] == 0 for r in got)


def test_equal_texts_share_a_shard(spark):
    rows = [(i, f"text {i % 300 if i % 4 else 'hot'}") for i in range(2000)]
    got = sharding.shard(spark, spark.createDataFrame(rows, "doc_id long, text string"), shards=7).collect()
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(got) == 2000
    spread = {}
    for r in got:
        spread.setdefault(rows[r["doc_id"]][1], set()).add(r["shard"])
    whole = [t for t in spread if t != "text hot" and len(spread[t]) == 1]
    assert len(whole) >= 0.8 * (len(spread) - 1)  # the hot group is larger than a shard; small ones stay together


def test_groups_that_fit_a_shard_stay_whole(spark):
    sizes = {"a": 100, "b": 60, "c": 30, "d": 15, "e": 260}
    texts = [t for t, n in sizes.items() for _ in range(n)] + [f"own {i}" for i in range(335)]
    random.Random(8).shuffle(texts)
    got = sharding.shard(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=8).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(800)) and set(Counter(r["shard"] for r in got).values()) == {100}
    assert len({(r["shard"], r["slot"]) for r in got}) == 800 and max(r["slot"] for r in got) == 99
    spread = {t: sorted(Counter(r["shard"] for r in got if texts[r["doc_id"]] == t).values()) for t in sizes}
    assert spread == {"a": [100], "b": [60], "c": [30], "d": [15], "e": [60, 100, 100]}


def test_packing_cases(spark, cases):
    rows, docs, _, _ = cases
    got = packing.pack_documents(spark, docs).collect()
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], []).append(r)
    assert set(of) == {i for i, _ in rows} and len(of[0]) == 1 and of[0][0]["length"] == 1
    assert len(of[3]) == 2 and {r["piece"] for r in of[3]} == {0}
    long_doc = sorted(of[4], key=lambda r: r["piece"])
    assert [r["piece"] for r in long_doc] == list(range(len(long_doc)))
    assert [r["start"] for r in long_doc] == [2048 * k for k in range(len(long_doc))]
    assert packing.pack_documents(spark, docs.filter("doc_id < -1")).count() == 0


def test_crossover_keeps_every_piece():
    rng = random.Random(12)
    lengths = [rng.randrange(1, 2049) for _ in range(500)]
    parents = []
    for _ in range(2):
        order = list(range(500))
        rng.shuffle(order)
        p = packing.Bins(lengths, 2048)
        p.insert(order)
        parents.append(p)
    child = packing.crossover(*parents, rng)
    assert sorted(i for b in child.bins for i in b) == list(range(500))
    assert all(sum(lengths[i] for i in b) <= 2048 for b in child.bins)


def test_html_cases(spark):
    page = "<html><body><nav>menu</nav><article><p>words of page {0}</p></article><footer>f</footer></body></html>"
    rows = [(i, f"http://h.org/{i}", page.format(i)) for i in range(12)] + [(None, None, None), (20, None, ""), (21, "no host", page.format(21)), (3, "http://h.org/3", page.format(3))]
    pages = spark.createDataFrame([(*r, None, None) for r in rows], "page_id long, url string, html string, host string, token long")
    got = html_extract.extract_pages(spark, pages).collect()
    assert Counter((r["page_id"], r["text"]) for r in got) == Counter((i, f"words of page {i}" if h else "") for i, _, h in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract_pages(spark, pages.filter("page_id < 0")).count() == 0


def test_em_finds_the_accuracies():
    rng, right = np.random.default_rng(13), np.array([0.9, 0.8, 0.7, 0.85, 0.75])
    truth = rng.random(20_000) < 0.6
    said = np.where(rng.random((20_000, 5)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    patterns, place, counts = np.unique(said, axis=0, return_inverse=True, return_counts=True)
    post, told, prior = quality.expectation_maximisation(patterns, counts.astype(float))
    assert np.abs(told[:, 1, 2] - right).max() < 0.04 and abs(prior - 0.6) < 0.04
    assert ((post[place.ravel()] > 0.5) == truth).mean() > 0.93
