"""The whole ranking against step-by-step rules in plain Python, crawling on a small web, and a search from end to end."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillrank import schema
from quillrank.operators import crawl, search
from quillrank.operators import store as K
from quillrank.plans import ranking
from quillrank.plans import search as api
from quillrank.schema import SearchPrefs

C = F.col
ROW = "query_id long, pos long, url string, domain string, title string, snippet string, final double, is_exploration boolean, outbound_links array<string>"


def similarity(bags):
    """Cosines of tf-idf vectors of some bags of words."""
    n, df = len(bags), Counter(t for b in bags for t in set(b))
    rows = [{t: k * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in Counter(b).items()} for b in bags]
    norms = [math.sqrt(sum(w * w for w in r.values())) or 1 for r in rows]
    return [[sum(w * b.get(t, 0) for t, w in a.items()) / x / y for b, y in zip(rows, norms, strict=True)] for a, x in zip(rows, norms, strict=True)]


def merged(near):
    parts = [[i] for i in range(len(near))]
    while len(parts) > 1:
        far = [(sum(1 - near[i][j] for i in a for j in b) / len(a) / len(b), x, y) for x, a in enumerate(parts) for y, b in enumerate(parts) if x < y]
        d, x, y = min(far, key=lambda f: (round(f[0], 12), f[1], f[2]))
        if d >= 0.35:
            break
        parts = [p for k, p in enumerate(parts) if k not in (x, y)] + [parts[x] + parts[y]]
    return parts


def expected(rows, trust, votes):
    """Places of one request's rows (dicts), step by step."""
    score = {r["pos"]: r["final"] for r in rows}
    order = sorted(rows, key=lambda r: -r["final"])
    head = order[:50]
    for r in head:
        from_ = {s["domain"] for s in head if s["domain"] and s["domain"] != r["domain"] and any(r["domain"] in x for x in s["outbound_links"] or [])}
        boost = min(0.05, round(sum(trust.get(d, 0.5) for d in from_) * 0.02, 4)) if r["domain"] else 0
        if boost:
            score[r["pos"]] = round(min(1.0, score[r["pos"]] + boost), 3)
    order = sorted(head, key=lambda r: -score[r["pos"]]) + order[50:]
    if len(order) > 5:
        head = order[:50]
        bags = [search.snippet_tokens(r["snippet"] or r["title"] or r["url"]) for r in head]
        parts = [sorted((head[i] for i in p), key=lambda r: -score[r["pos"]]) for p in merged(similarity(bags))]
        parts.sort(key=lambda p: -score[p[0]["pos"]])
        top = [p[k] for k in range(50) for p in parts if k < len(p)][:10]
        order = top + [r for r in order if r not in top]
        top, rest, seen = [], [], Counter()
        for r in order:
            if len(top) < 10 and seen[r["domain"]] < 2:
                top.append(r)
                seen[r["domain"]] += 1
            else:
                rest.append(r)
        come = [r for r in rest if r["is_exploration"]][: max(0, 2 - sum(r["is_exploration"] for r in top))]
        go = sorted((r for r in top if not r["is_exploration"]), key=lambda r: score[r["pos"]])
        for a, b in zip(come, go, strict=False):
            top[top.index(b)] = a
            rest.remove(a)
            rest.append(b)
        if come:
            top.sort(key=lambda r: -score[r["pos"]])
        order = top + rest
    if any(votes.get(r["url"]) for r in order):
        for r in order:
            v = votes.get(r["url"], 0)
            if v:
                score[r["pos"]] = round(max(0.0, min(1.0, score[r["pos"]] + math.copysign(0.03, v))), 3)
        order.sort(key=lambda r: -score[r["pos"]])
    return [(r["pos"], round(score[r["pos"]], 3)) for r in order]


def test_ranking_against_the_steps(spark):
    rng = random.Random(3)
    topics = [[f"{c}{c}word{k}" for k in range(8)] for c in "abcdefg"]
    rows = []
    for q, n in enumerate((3, 5, 6, 12, 30, 70)):
        for p in range(n):
            links = [f"https://d{rng.randrange(12)}.org/x{rng.randrange(5)}" for _ in range(rng.randrange(4))] if rng.random() < 0.3 else None
            # scores of a set differ, and by more than a boost's rounding, so no step meets a tie by accident
            rows.append((q, p, f"https://d{p % 12}.org/{q}-{p}", f"d{rng.randrange(12)}.org", f"title {p}", " ".join(rng.sample(rng.choice(topics), 6)), round(0.2 + 0.0071 * ((p * 37) % n), 3), rng.random() < 0.12, links))
    trust = {"d1.org": 0.9, "d2.org": 0.1}
    votes = {f"https://d{p % 12}.org/4-{p}": (2 if p % 2 else -1) for p in range(0, 30, 7)}
    got = ranking.reordered(spark.createDataFrame(rows, ROW), spark.createDataFrame(list(trust.items()), "domain string, trust double"), spark.createDataFrame(list(votes.items()), "url string, votes long")).collect()
    names = [f.split()[0] for f in ROW.split(", ")]
    for q in range(6):
        mine = [(r["pos"], round(r["final"], 3)) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert mine == expected([dict(zip(names, r, strict=True)) for r in rows if r[0] == q], trust, votes), q
    labelled = [r for r in got if r["query_id"] == 4]
    assert all(r["cluster_label"] for r in labelled) and min(r["cluster_id"] for r in labelled) == 0
    assert all(r["cluster_id"] is None for r in got if r["query_id"] < 2)


def test_labels():
    assert search.label_of(["red fox runs", "red fox sleeps", "blue fox"], "t") == "fox · red · runs"
    assert search.label_of(["a of", ""], "The title") == "The title" and search.label_of([""], "") == "cluster"


def test_identical_snippets_make_one_cluster_and_topics_several(spark):
    one = [(1, p, p + 1, f"u{p}", "", "all the same words here", 0.5) for p in range(6)]
    five = [(2, p, p + 1, f"u{p}", "", f"{c}one {c}two {c}three", 0.5) for p, c in enumerate("vwxyz")]
    empty = [(3, 0, 1, "u", None, None, 0.5)]
    got = search.cluster_results(spark.createDataFrame(one + five + empty, "query_id long, pos long, rank int, url string, title string, snippet string, final double")).collect()
    count = {q: len({r["cluster_id"] for r in got if r["query_id"] == q}) for q in (1, 2, 3)}
    assert len(got) == 12 and count == {1: 1, 2: 5, 3: 1}


def page(links=(), words=0):
    return "<html><body>" + "".join(f'<a href="{x}">l</a>' for x in links) + " word" * words + "</body></html>"


@pytest.fixture(scope="module")
def web(spark):
    pages = {
        "https://seed.org/a": page(["/one", "/two#x", "/two", "/tag/x", "/pic.png", "/", "https://new.org/wiki/page", "https://dark.net/post", "mailto:x"], 10),
        "https://seed.org/one": page((), 150), "https://seed.org/two": page((), 99), "https://seed.org/three": page((), 200),
        "https://new.org/wiki/page": page((), 120), "https://dark.net/post": page((), 130), "https://low.io/": page(["/deep/article-one-two", "/deep/b", "/deep/b"], 5),
        "https://low.io/deep/article-one-two": page((), 140), "https://low.io/deep/b": page((), 121),
    }
    landed = spark.createDataFrame(list(pages.items()), "url string, html string")
    trust = spark.createDataFrame([("seed.org", 0.8), ("new.org", 0.6), ("dark.net", 0.2)], "domain string, trust double")
    results = spark.createDataFrame([(0, 0, 1, "https://seed.org/a", "seed.org", 0.7, ["https://new.org/wiki/page", "https://dark.net/post"]), (0, 1, 2, "https://low.io/", "low.io", 0.65, None), (0, 2, 3, "https://bad.com/x", "bad.com", 0.1, [])], "query_id long, pos long, rank int, url string, domain string, final double, outbound_links array<string>")
    return landed, trust, results


def test_links_of_pages(spark, web):
    landed, _, _ = web
    seed = landed.filter("url = 'https://seed.org/a'")
    assert [r["link"] for r in crawl.internal_links(seed).orderBy("nth").collect()] == ["https://seed.org/one", "https://seed.org/two"]
    assert [r["link"] for r in crawl.outbound_links(seed).orderBy("nth").collect()] == ["https://new.org/wiki/page", "https://dark.net/post"]
    assert crawl.site_links(seed).count() == 6


def test_crawling_deeper(spark, web):
    landed, trust, results = web
    got = crawl.deeper(results, landed, trust).collect()
    assert {(r["url"], r["discovered_via"], r["word_count"]) for r in got} == {("https://seed.org/one", "https://seed.org/a", 150), ("https://low.io/deep/article-one-two", "https://low.io/", 140)}
    assert all(r["snippet"].endswith("…") and len(r["snippet"].split()) == 40 for r in got)


def test_seed_expansion(spark, web):
    landed, trust, results = web
    places = [(r["domain"], r["place"]) for r in crawl.seed_candidates(results, trust).orderBy("place").collect()]
    assert places == [("new.org", 1), ("dark.net", 2)]  # better trusted first
    got = {r["url"]: r["is_exploration"] for r in crawl.expand_seeds(results, landed, trust).collect()}
    assert got == {"https://new.org/wiki/page": False, "https://dark.net/post": False}
    # without a trust pool only the exploration pool is left, which asks for little trusted domains
    got = {r["url"]: r["is_exploration"] for r in crawl.expand_seeds(results, landed, trust, pool=0).collect()}
    assert got == {"https://dark.net/post": True}


def test_domain_exploration(spark, web):
    landed, trust, results = web
    none = spark.createDataFrame([], "domain string, avg_score double")
    got = crawl.explore_domains(results, landed, trust, none).collect()
    # seed.org gets five pages: /one has 151 words, /two fewer than 120; low.io gets one, its best link
    assert {r["url"] for r in got if not r["is_exploration"]} == {"https://seed.org/one", "https://low.io/deep/article-one-two"}
    assert crawl.best_seeds(results).count() == 2


def record(i, source="ddg", **more):
    return {"pos": i, "url": f"https://site{i}.org/page-about-things/{i}", "domain": f"site{i}.org", "title": f"Distinct{i} heading{i} number{i}", "snippet": f"snippet{i} about{i} item{i}", "source": source, "word_count": 300 + i, "content": f"own{i} " * 60 + "Text. " * 40, **more}


def frame(spark, rows):
    return schema.conformed(spark.createDataFrame([{**r} for r in rows], "pos long, url string, domain string, title string, snippet string, source string, word_count int, content string"), schema.RESULT)


def test_search_end_to_end(spark):
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp")
    pages = spark.createDataFrame([("https://kept.org/cats", "kept.org", "Cats and dogs", "about cats", "cats dogs " * 80, 160, 0.9)], "url string, domain string, title string, snippet string, content string, word_count int, score double")
    domains = spark.createDataFrame([("kept.org", 5, 0.9, "2024-01-31 00:00:00"), ("site1.org", 2, 0.6, "2024-01-31 00:00:00"), ("once.org", 1, 0.9, "2024-01-31 00:00:00")], "domain string, page_count long, avg_score double, last_seen string")
    store = api.Store(spark, pages=pages, domains=domains)
    sources = {"ddg": lambda s, q: frame(s, [record(i) for i in range(4)]), "brave": lambda s, q: frame(s, [record(i, "brave") for i in range(2, 7)]), "reddit": lambda s, q: frame(s, [record(9, "reddit")])}
    got = api.search(spark, store, SearchPrefs("cats dogs", max_results=5), as_of, sources)
    rows, m = got.results.collect(), got.metrics
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5] and m["total"] == 8 and m["cache_hits"] == 1 and m["intent"] == "informational"
    assert sum(m["trust_distribution"].values()) == m["total"] and set(m["trust_distribution"]) == {"high", "medium", "low"} and m["trusted_domains"] == 2
    assert m["sources_used"] == {"cache": 1, "ddg": 4, "brave": 3} and m["query_variants"] == 3 and m["crawl_budget"] is None and m["saved_pages_total"] == 1
    assert {c for c in rows[0].asDict()} >= {"final", "info_density", "obscurity", "commercial", "freshness", "diversity", "ai_spam", "cluster", "cluster_label", "score_band", "is_high_spam"}
    assert all(0 <= r["final"] <= 1 for r in rows)
    stored = store.added["pages"].collect()
    assert all(r["score"] >= 0.6 and r["query_tags"] == ["cats dogs"] for r in stored)

    # two votes against the first result move it down; taking one back is no vote for it
    first = rows[0]["url"]
    assert api.vote(spark, store, first, "cats dogs", -1, as_of) == {"ok": True} and not api.vote(spark, store, first, "x", 0)["ok"]
    again = api.search(spark, store, SearchPrefs("cats dogs", max_results=5), as_of, sources).results.collect()
    assert next((r["final"] for r in again if r["url"] == first), 0) <= rows[0]["final"] - 0.029
    later = F.lit("2024-02-01 00:00:09").cast("timestamp")
    api.retract(spark, store, first, "cats dogs", later)
    assert K.votes_of(store.votes, spark.createDataFrame([(first,)], "url string")).first()["votes"] == 0
    assert api.stats(store)["total_pages"] == 1


def test_search_without_sources(spark):
    got = api.search(spark, api.Store(spark), SearchPrefs("nothing here"), sources={})
    assert got.metrics == {"query": "nothing here", "total": 0, "error": "No results from any source."} and got.results.count() == 0


def test_hard_filters(spark):
    rows = spark.createDataFrame([("amazon.com", "https://amazon.com/x", 900), ("myforum.org", "https://myforum.org/", 800), ("x.org", "https://x.org/t/1", 801), ("reddit.com", "https://reddit.com/", None)], "domain string, url string, word_count int")
    kept = lambda **p: {r["domain"] for r in ranking.filtered(rows, SearchPrefs("q", **p)).collect()}
    assert kept(exclude_corporate=True) == {"myforum.org", "x.org", "reddit.com"}
    assert kept(forums_only=True) == {"myforum.org", "x.org", "reddit.com"} and kept(long_form_only=True) == {"amazon.com", "x.org"}


@pytest.mark.parametrize("bad", [{"query": ""}, {"query": "x" * 501}, {"query": "q", "underground_bias": 1.1}, {"query": "q", "max_results": 51}, {"query": "q", "max_results": 0}, {"query": "q", "deep_crawl": 1}])
def test_requests_are_checked(bad):
    with pytest.raises(ValueError):
        SearchPrefs(**bad)


def test_defaults_and_votes_are_checked():
    assert SearchPrefs("q").max_results == 20
    with pytest.raises(ValueError):
        schema.check_vote("u", "q", 5)


def test_store_pages(spark):
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp")
    results = spark.createDataFrame([("https://a.org", "a.org", "T", "s", "w " * 4000, 4000, 0.7, 0.65, 0.75), ("https://b.org", "b.org", "T", "s", None, 80, 0.6, 0.0, 0.0), ("https://c.org", "c.org", "T", "s", "x", 79, 0.9, 0.0, 0.0), ("", "d.org", "T", "s", "x", 100, 0.9, 0.0, 0.0), ("https://e.org", "e.org", "T", "s", "x", 100, 0.9, 0.66, 0.0)], "url string, domain string, title string, snippet string, content string, word_count int, final double, ai_spam double, commercial double")
    none = F.lit(None).cast("string")
    results = results.withColumns({"publish_date": none, "author": none, "source": F.lit("ddg"), "cluster": none})
    first = K.store_pages(schema.empty(spark, schema.PAGES), K.stored(results, "q1", as_of))
    second = {r["url"]: r for r in K.store_pages(first, K.stored(results.withColumn("source", F.lit("brave")), "q2", as_of)).collect()}
    assert set(second) == {"https://a.org", "https://b.org"} and second["https://a.org"]["query_tags"] == ["q1", "q2"]
    assert len(second["https://a.org"]["content"].split()) == 3000 and second["https://b.org"]["content"] == "s" and second["https://a.org"]["source"] == "ddg"


def test_rank_scores_of_odd_pages_equal_their_sql(spark, tmp_path):
    import duckdb

    from quillrank import catalogue, catalogue_plans  # noqa: F401

    titles = [
        "ÉTÉ ÜBER ÄRGER now", "ABCÉ DEFÜ GHIß kalt", "AÉBCD and more", " Best of all  ", "\tBest of all\n", "top\tten of all", "best things | a\n|\nb", "5 thingsé of a day", "Über5 ways of a day",
        "5 wayſ of a day", "beſt of all", "Nİcht WİTH a b c d e f", "NICHT WITH one two three four", "short",
    ]
    phrases = ["ébest 10 picks", "best 10é", "buy nowß", "ümoreover thusé", "éin conclusion", "add\x0bto cart", "save 5%", "ſave 5%", "networK", "20 USDé", "read moreé x", "privacy policyß", "bestbuy.com  affiliate", "# A b # C d\x85# E f", "MECHANİSM ΑΣ Σ"]
    rows = []
    for i in range(80):
        body = " ".join(f"word{i * k % 23} {phrases[(i + k) % len(phrases)]}{'.' if k % 3 else ''}" for k in range(0, 40 if i % 4 else 8))
        rows.append((i, f"https://site{i % 9}.example{i % 3}.org/a/b{i}", f"<html><title>{titles[i % len(titles)]}</title><nav>x</nav><ſcript>y</script><p> {body}　</p></html>"))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(catalogue.ORACLES["rank_scores"]).fetchall()
    got = [tuple(r) for r in catalogue.QUERIES["rank_scores"](spark, str(tmp_path)).collect()]
    assert len(got) == len(rows) and sorted(got) == sorted(want)
