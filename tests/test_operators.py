"""Operators of the ranking engine on small fixtures and against plain-Python rules."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillrank import catalogue
from quillrank.functions import text as T
from quillrank.functions import urls as U
from quillrank.operators import budget, dedup, ranking, search, signals, store

WEIGHTS = {
    ("informational", ()): (0.26, 0.22, 0.2, 0.09, 0.09, 0.14),
    ("deep_research", ()): (0.2590, 0.2506, 0.2, 0.0752, 0.0752, 0.14),
    ("navigational", ()): (0.2724, 0.1467, 0.2, 0.0943, 0.1467, 0.14),
    ("informational", (("less_seo", True),)): (0.1954, 0.1653, 0.28, 0.0676, 0.0676, 0.2240),
    ("informational", (("prefer_forums", True),)): (0.2258, 0.2779, 0.2, 0.0782, 0.0782, 0.14),
    ("informational", (("underground", 1.0),)): (0.1505, 0.3427, 0.2, 0.0834, 0.0834, 0.14),
    ("informational", (("fresh", 1.0),)): (0.2335, 0.1976, 0.2, 0.1482, 0.0808, 0.14),
}


@pytest.mark.parametrize("case", WEIGHTS)
def test_weights(case):
    w = ranking.weights(case[0], **dict(case[1]))
    assert tuple(w[k] for k in ranking.SIGNALS) == pytest.approx(WEIGHTS[case], abs=2e-4)


def test_urls(spark):
    rows = spark.createDataFrame([("https://www.Shop.co.uk:80/a/?q=1#x",), ("http://h.org",), (None,), ("javascript:void(0)",)], "url string")
    got = rows.select(U.host(F.col("url")).alias("h"), U.registered_domain(U.host(F.col("url"))).alias("r"), U.dedup_key(F.col("url")).alias("k"), U.skipped(F.col("url")).alias("s")).collect()
    assert [tuple(x) for x in got[:2]] == [("shop.co.uk", "shop.co.uk", "shop.co.uk:80/a?q=1", False), ("h.org", "h.org", "h.org", False)]
    assert got[2]["s"] and got[3]["s"]


def test_scores_lie_in_the_unit_interval(spark):
    texts = ["", None, "one two", "Word. " * 300, "A b c d e f g h. " * 50, "ÀÉ ñ " * 100]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(signals.info_density(F.col("t")).alias("a"), signals.ai_spam(F.lit("x"), F.col("t")).alias("b"), signals.commercial_bias(F.col("t"), F.lit("")).alias("c")).collect()
    assert all(0 <= v <= 1 for r in got for v in r)
    assert got[0]["a"] == 0.05


def test_allocation_follows_the_sequential_rule(spark):
    rng = random.Random(5)
    rows = [(s, f"d{rng.randrange(4)}", p, rng.randrange(1, 5), 6) for s in range(20) for p in range(15)]
    got = {(r["set_id"], r["pos"]): r["granted"] for r in budget.allocate(spark.createDataFrame(rows, "set_id int, domain string, pos int, want int, limit int"), "set_id", 17).collect()}
    for s in range(20):
        pool, used = 17, {}
        for _, d, p, want, limit in [r for r in rows if r[0] == s]:
            g = max(0, min(want, limit - used.get(d, 0), pool))
            used[d], pool = used.get(d, 0) + g, pool - g
            assert got[s, p] == g


def test_title_pairs_against_all_pairs(spark):
    rng = random.Random(3)
    sets = {i: sorted({rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(0, 9))}) for i in range(60)}
    got = {(r["a"], r["b"]) for r in dedup.title_pairs(spark.createDataFrame(list(sets.items()), "pos long, tokens array<string>")).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= 0.75}
    assert got == want


def test_exact_dedup_is_greedy(spark):
    rows = [(1, 1, "u1", ["a", "b", "c", "d"]), (1, 2, "u2", ["a", "b", "c", "d", "e"]), (1, 3, "u2", ["x"]), (1, 4, "u1", ["y"]), (1, 5, "u5", [])]
    got = dedup.dedup_exact(spark.createDataFrame(rows, "set_id int, pos int, url_key string, tokens array<string>"), "set_id").collect()
    assert sorted(r["pos"] for r in got) == [1, 3, 5]


def greedy(rows):
    """The reference's rule over one list in order; rows (pos, url_key, tokens)."""
    kept = []
    for pos, key, tokens in sorted(rows):
        t = set(tokens)
        if not any(key == k or (t and u and len(t & u) / len(t | u) >= 0.75) for _, k, u in kept):
            kept.append((pos, key, t))
    return [p for p, _, _ in kept]


def test_exact_dedup_against_the_plain_fold(spark):
    rng = random.Random(7)
    rows = [(s, p, f"u{rng.randrange(90)}", rng.sample("abcdefgh", rng.choice((0, 4, 5, 6, 7)))) for s in range(3) for p in range(60)]
    rows += [(3, p, f"u{p}", list("abcdefghijklmnopqrst"[p : p + 10])) for p in range(10)]  # a chain: each like the next only
    got = dedup.dedup_exact(spark.createDataFrame(rows, "set_id int, pos int, url_key string, tokens array<string>"), "set_id").collect()
    assert sorted((r["set_id"], r["pos"]) for r in got) == [(s, p) for s in range(4) for p in greedy([x[1:] for x in rows if x[0] == s])]


def test_registered_exact_dedup_is_over_the_whole_table(spark, tmp_path):
    rng = random.Random(11)
    titles = [[f"w{rng.randrange(400)}" for _ in range(10)] for _ in range(40)]
    rows = []
    for i in range(240):
        t = list(rng.choice(titles))
        t[rng.randrange(10)] = f"w{rng.randrange(400)}"
        rows.append((i, f"https://h{i % 90}.org/{'' if i % 4 else 'x'}#{i}", f"<title>{' '.join(t)}</title>"))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(r["pos"] for r in catalogue.QUERIES["dedup_exact"](spark, str(tmp_path)).collect())
    assert got == greedy([(i, u.split("#")[0].rstrip("/"), h[7:-8].split()) for i, u, h in rows]) and len(got) < 200


def test_rank_linear_against_its_sql(spark, tmp_path):
    rng = random.Random(13)
    lines = lambda n: ". ".join(" ".join("abcdefghijklmnopqrst"[rng.randrange(20)] * 6 for _ in range(rng.randrange(5, 14))) for _ in range(n))
    body = lines(30)
    texts = [body, body, body + " In conclusion, it is important to note that moreover. First and foremost.", "Best 10 picks, add to cart, affiliate, we may earn a commission. $20 with a coupon code, free trial. " + body, "\n\n".join([lines(3)] * 4) + "\n# Heading one\n## Two\n", "same words here again now. " * 20, lines(3), ""]
    texts += [lines(12) for _ in range(8)]
    domains = ["a.example.org", "a.example.org", "my-forum.io", "deals.shop.com", "wikipedia.org", "en.wikipedia.org", "blog.net", "x.de"]
    rows = [(i, t, domains[i % 8] if i < 8 else f"s{i}.org", "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in catalogue.QUERIES["rank_linear"](spark, str(tmp_path)).collect()]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == [(i, s, pytest.approx(f, abs=2e-6)) for i, s, f in db.execute(catalogue.ORACLES["rank_linear"]).fetchall()]
    final = {i: f for i, _, f in got}
    assert final[0] - final[1] == pytest.approx(0.1, abs=1e-6)  # a copy loses the near-duplicate penalty
    assert final[3] < final[0] - 0.03  # affiliate and price words count


def test_content_type_reads_the_page(spark, tmp_path):
    bodies = {1: "<p>Abstract. Smith et al</p>", 2: "<p>Buy now</p>", 3: "<p>Written by me</p>", 4: "<script>buy now</script><p>plain</p>", 5: None}
    spark.createDataFrame([(i, f"https://x.org/p{i}", h) for i, h in bodies.items()], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["kind"] for r in catalogue.QUERIES["content_type"](spark, str(tmp_path)).collect()}
    assert got == {1: "Academic", 2: "Commercial", 3: "Blog", 4: "Unknown", 5: "Unknown"}


def test_blending_keeps_caps_and_injects(spark):
    rows = [(1, i, f"d{i // 4}", i in (20, 25), 1 - i / 40) for i in range(30)]
    df = ranking.ranked(spark.createDataFrame(rows, "set_id int, pos int, domain string, is_exploration boolean, final double"), by=("set_id",))
    out = ranking.inject_exploration(ranking.domain_cap(df, "set_id"), "set_id").collect()
    top = [r for r in out if r["in_final"]]
    assert len(out) == 30 and len(top) == 10 and sum(r["is_exploration"] for r in top) == 2


def test_clusters_partition_their_set(spark):
    rows = [(1, p, t, 1.0) for p, t in enumerate(["a", "a", "b", "c", "c", "c"])]
    got = {r["pos"]: r["cluster"] for r in search.clusters(spark.createDataFrame(rows, "set_id long, pos long, term string, weight double")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 3}


def brute_linkage(vectors, threshold=0.35):
    """Average linkage by the mean distance of all pairs, recomputed for each merge; vectors {pos: {term: weight}}."""
    far = {(p, q): 1 - sum(w * vectors[q].get(t, 0) for t, w in vectors[p].items()) for p in vectors for q in vectors}
    parts = [[p] for p in sorted(vectors)]
    while len(parts) > 1:
        d, i, j = min((sum(far[p, q] for p in a for q in b) / len(a) / len(b), i, j) for i, a in enumerate(parts) for j, b in enumerate(parts) if i < j)
        if d >= threshold:
            break
        parts[i] += parts.pop(j)
    return {frozenset(p) for p in parts}


def test_registered_clusters_against_brute_linkage(spark, tmp_path):
    rng = random.Random(17)
    topics = [[f"{c}word{k}" for k in range(12)] for c in "abcde"]
    rows = [(i, " ".join(rng.sample(rng.choice(topics), 10) + [f"own{chr(97 + i % 26)}x"]), "s", "en") for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in catalogue.QUERIES["semantic_clusters"](spark, str(tmp_path)).collect():
        got.setdefault((r["set_id"], r["cluster"]), set()).add(r["pos"])
    vectors = {}
    for r in catalogue.QUERIES["tfidf"](spark, str(tmp_path)).collect():
        vectors.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    want = {(s, c) for s in range(3) for c in brute_linkage({p: v for p, v in vectors.items() if p // 40 == s})}
    assert {(k[0], frozenset(v)) for k, v in got.items()} == want and 3 < len(want) < 100


def test_store(spark):
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    df = spark.createDataFrame([(1, 0.9, "2024-01-01 00:00:00"), (2, 0.7, "2024-01-23 00:00:00"), (3, 0.1, "2024-01-28 00:00:00"), (4, 0.9, "2023-12-31 23:59:59")], "id int, score double, at string").withColumn("cached_at", F.col("at").cast("timestamp"))
    assert sorted(r["id"] for r in store.alive(df, as_of).collect()) == [1, 3]
    old, new = spark.createDataFrame([("a", 1, "x")], "url string, n int, src string"), spark.createDataFrame([("a", 2, "y"), ("b", 3, "z")], "url string, n int, src string")
    assert sorted(map(tuple, store.upsert(old, new, "url", ["n"]).collect())) == [("a", 2, "x"), ("b", 3, "z")]


def test_intent(spark):
    cases = {"": "informational", "latest phones": "freshness_sensitive", "phones 2022": "informational", "phones 2023": "freshness_sensitive", "github login": "navigational", "a b c d e": "deep_research", "cat pictures": "informational"}
    got = spark.createDataFrame([(q,) for q in cases], "q string").select("q", search.intent(F.col("q")).alias("i")).collect()
    assert {r["q"]: r["i"] for r in got} == cases


def test_let_is_transparent(spark):
    assert spark.range(1).select(T.let(F.lit(2), lambda x: x + x)).first()[0] == 4


def test_query_variants_of_odd_turns_equal_their_sql(spark, tmp_path):
    texts = [None, "", " ", " ", "　 Best ", "   best x   ", "Übest enente ch", "Undülichü bestß dem teöü", "guİde and best", "networKx net", "ſcience now", "MECHANİSM now", "a\x0bbest\x0c x"]
    rows = [(3 * i + k, i, "user", t) for i, t in enumerate(texts) for k in range(12)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    for name in ("query_variants", "extra_variants"):
        want = con.execute(catalogue.ORACLES[name]).fetchall()
        got = [tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()]
        assert len(got) == len(rows) and sorted(got) == sorted(want)
