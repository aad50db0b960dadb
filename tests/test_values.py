"""Fixed values of the rules, checked one by one: expected numbers are worked out by hand from the stated rules."""

import pytest
from pyspark.sql import functions as F

from quillrank.functions import lexicons as L
from quillrank.functions import urls as U
from quillrank.operators import budget, search, signals, store

C = F.col


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()]


def test_sizes_of_the_families():
    sizes = {"FILLER": 32, "MAINSTREAM": 54, "COMMUNITY": 18, "PERSONAL": 10, "SUFFIX_WEIGHT": 12, "GENERIC_PHRASES": 25, "CONNECTIVES": 20, "AFFILIATE": 25, "LISTICLE": 27, "PRICES": 16, "BOILERPLATE": 14, "FRESH": 11, "NAVIGATIONAL": 5, "DEEP": 12, "SYNONYMS": 36, "SKIPPED_LINKS": 33, "CORPORATE": 43, "FORUM_HOSTS": 10, "FORUM_PARTS": 13, "TITLE_STOPWORDS": 18, "FORUM_DOMAINS": 18, "ACADEMIC_DOMAINS": 16, "NEWS_DOMAINS": 20, "DOCS_DOMAINS": 11, "FORUM_URLS": 15, "ACADEMIC_URLS": 11, "DOCS_URLS": 11, "NEWS_URLS": 8, "ACADEMIC_TEXT": 11, "COMMERCIAL_TEXT": 8, "BLOG_TEXT": 8}
    assert {k: len(getattr(L, k)) for k in sizes} == sizes


def test_link_scores(spark):
    cases = {
        "https://x.edu/": 0.2 * 0.2 + 0.35 * 0.3 + 0.15 * 1.0 + 0.2,
        "https://x.ac.uk/one": 0.2 * 0.5 + 0.35 * 0.14 + 0.15 + 0.2,
        "https://x.gov/2021/long-title-of-the-text.html": 0.2 * 0.9 + 0.35 * 0.7 + 0.1 + 0.15 * 0.9 + 0.2,
        "https://x.org/blog/12345": 0.2 * 0.9 + 0.35 * 0.1 + 0.15 * 0.75 + 0.2,
        "https://x.net/a/b/c/d": 0.2 * 0.7 + 0.0 + 0.15 * 0.65 + 0.2,
        "https://x.com/a/b/c/d/e/f": 0.2 * 0.4 + 0.15 * 0.55 + 0.2,
        "https://x.io/wiki/deadbeef01": 0.2 * 0.9 + 0.35 * 0.1 + 0.15 * 0.6 + 0.2,
        "https://x.de/wiki/abc": 0.2 * 0.9 + 0.35 * 0.44 + 0.15 * 0.6 + 0.2,
        "https://x.com/tag/a": 0.0,
        "https://x.com/a?utm_source=b": 0.0,
        "ftp://x.com/a": 0.0,
        "": 0.0,
    }
    got = values(spark, [(u,) for u in cases], "u string", U.link_score(C("u")))
    assert [g for (g,) in got] == [pytest.approx(v, abs=6e-4) for v in cases.values()]


def test_resolution(spark):
    page = "https://h.org/a/b/page.html?q=1#f"
    cases = {"c.html": "https://h.org/a/b/c.html", "../c": "https://h.org/a/c", "../../../c": "https://h.org/c", "./c?x=../y": "https://h.org/a/b/c?x=../y", "/c/./d/..": "https://h.org/c/", "//o.org/x": "https://o.org/x", "?z": "https://h.org/a/b/page.html?z", "#g": "https://h.org/a/b/page.html?q=1#g", "": "https://h.org/a/b/page.html?q=1", "mailto:x@y": "mailto:x@y", "http://o.org": "http://o.org"}
    got = values(spark, [(h,) for h in cases], "h string", U.resolve(F.lit(page), C("h")))
    assert [g for (g,) in got] == list(cases.values())


def test_site_types_and_suffixes(spark):
    cases = [("my-site.org", 0.53, 0.05), ("docs.site.com", 0.51, -0.05), ("m.site.de", 0.45, 0.04), ("forum.site.io", 0.80, 0.09), ("blog.site.edu", 0.70, 0.10), ("a.b-c.co.uk", 0.59, 0.0), ("localhost", 0.45, -0.05), ("x.shop", 0.45, -0.10), ("x.co", 0.45, -0.03)]
    got = values(spark, [(d,) for d, _, _ in cases], "d string", signals.site_type(C("d"), C("d")), signals.suffix_weight(C("d")))
    assert got == [(pytest.approx(a), pytest.approx(b)) for _, a, b in cases]


def test_obscurity(spark):
    rows = [("wikipedia.org", "https://wikipedia.org/"), ("en.wikipedia.org", "https://en.wikipedia.org/"), ("x.org", "https://x.org/a/index.html")]
    got = values(spark, rows, "d string, u string", signals.obscurity(C("d"), C("u"), F.lit(1.0), F.lit(0.12)))
    assert [g for (g,) in got] == [0.04, 0.08, pytest.approx(0.4 * 0.45 + 0.1 * 0.05 + 0.15 * (1 - 1 / 1.4) + 0.35 - 0.12)]


def test_title_stuffing(spark):
    cases = {"short": 0.0, "A | B | C and more": 0.55, "A – B and more": 0.20, "My 10 tips": 0.25, "x" * 71: 0.12, "x" * 91: 0.30, "Some (really) [good] title": 0.20, "WE GO": 0.0, "THE BIG SALE": 0.20, "THE BIG thing": 0.08, "Best of all": 0.15, "a 100 tips for it": 0.0, "A: B - C title": 0.0}
    got = values(spark, [(t,) for t in cases], "t string", signals.title_stuffing(C("t")))
    assert dict(zip(cases, [g for (g,) in got], strict=True)) == {t: pytest.approx(v) for t, v in cases.items()}


def test_headings_and_templates(spark):
    body = "word " * 149
    same = "".join(f"## Best item {i}\n" for i in range(5))
    mixed = "".join(f"## {w} item\n" for w in ("a", "b", "c", "d", "e"))
    got = values(spark, [(body + "\nBIG HEADING\n",), (same,), (mixed,), (same[: same.index("4") - 13],)], "t string", signals.heading_density(C("t")), signals.templated_headings(C("t")))
    assert got[0][0] == pytest.approx(1 / (151 / 150)) and [g[1] for g in got] == [False, True, False, False]


def test_commercial(spark):
    rows = [("affiliate affiliate", "x.org"), ("", "best-shop.org"), ("buy now buy now", "x.org"), ("$5 and 7 USD", "x.org"), ("plain", "x.org")]
    got = values(spark, rows, "t string, d string", signals.commercial_bias(C("t"), C("d")))
    assert [g for (g,) in got] == [pytest.approx(x) for x in (2 / 3 * 0.4, 0.075, 2 / 6 * 0.35, 2 / 6 * 0.15, 0.0)]


def test_content_types(spark):
    rows = [
        ("https://en.wikipedia.org/wiki/X", "", "Wiki"), ("https://lobste.rs/s/1", "", "Forum"), ("https://cs.x.edu/p", "", "Academic"), ("https://cnn.com/x", "", "News"),
        ("https://x.readthedocs.io/en", "", "Docs"), ("https://myforum.org/x", "", "Forum"), ("https://x.org/docs/api/", "", "Docs"), ("https://x.org/news/story/", "", "News"),
        ("https://x.org/a", "add to cart", "Commercial"), ("https://x.org/a", "posted by someone", "Blog"), ("https://x.org/a", "", "Unknown"), ("https://theshopblog.org/a", "", "Commercial"),
        ("https://x.org/article/", "", "Academic"),
    ]
    got = values(spark, rows, "u string, t string, k string", signals.content_type(C("u"), C("t")), C("k"))
    assert [a for a, _ in got] == [b for _, b in got]


def test_dates(spark):
    cases = {"2024-01-02": "2024-01-02 00:00:00", "2024-01-02T03:04:05": "2024-01-02 03:04:05", "2024-01-02T03:04:05Z": "2024-01-02 03:04:05", "2024-01-02T03:04:05+0200": "2024-01-02 01:04:05", "2024-01-02T03:04:05+02:00": "2024-01-02 01:04:05", "January 2, 2024": "2024-01-02 00:00:00", "Jan 2, 2024": "2024-01-02 00:00:00", "2 January 2024": "2024-01-02 00:00:00", "2 Jan 2024": "2024-01-02 00:00:00", "2024": "2024-01-01 00:00:00", "3 days ago": None, "": None, None: None}
    got = values(spark, [(t,) for t in cases], "t string", F.date_format(signals.parsed_date(C("t")), "yyyy-MM-dd HH:mm:ss"))
    assert [g for (g,) in got] == list(cases.values())


def test_freshness(spark):
    rows = [("2024-01-01 12:00:00",), ("2024-02-01 00:00:00",), ("2025-01-01 00:00:00",), (None,)]
    got = values(spark, rows, "t string", signals.freshness(C("t").cast("timestamp"), F.lit("2024-02-01 00:00:00").cast("timestamp")))
    assert [g for (g,) in got] == [pytest.approx(2.718281828 ** (-30 / 365)), 1.0, 1.0, 0.5]


def test_intents_and_variants(spark):
    intents = {"facebook earnings today": "freshness_sensitive", "phones 2022": "informational", "phones 2029": "freshness_sensitive", "github": "navigational", "example.com": "navigational", "how does a cat work": "deep_research", "cats versus dogs": "deep_research", '"exact words"': "deep_research", "old cat pictures here now then": "deep_research", "cat pictures": "informational"}
    got = values(spark, [(q,) for q in intents], "q string", search.intent(C("q")))
    assert [g for (g,) in got] == list(intents.values())
    variants = {
        "Best guide": ["Best guide", "Best guide research", "how Best guide works", "Best guide discussion", "Best tutorial"],
        "why cats study": ["why cats study", "why cats study discussion", "why cats research"],
        "one two three four five": ["one two three four five", "one two three four five explained", "one two three four five discussion"],
        "": [""],
    }
    got = values(spark, [(q,) for q in variants], "q string", search.variants(C("q")), search.extra_variants(C("q")))
    assert [a for a, _ in got] == list(variants.values()) and [b for _, b in got] == [v[1:4] for v in variants.values()]


def test_similar_queries(spark):
    memory = spark.createDataFrame([("quantum computing", 3), ("quantum", 9), ("cooking", 1), ("quantum computer", 2)], "query string, search_count int")
    assert [r["query"] for r in search.similar_queries(memory, "quantum computing").collect()] == ["quantum", "quantum computing"]
    assert [r["query"] for r in search.similar_queries(memory, "quantum computing", 0.84, exact=True).collect()] == ["quantum", "quantum computing", "quantum computer"]


def test_budget(spark):
    assert [budget.pools(25, i) for i in ("deep_research", "freshness_sensitive", "navigational", "informational", "other")] == [(17, 8), (22, 3), (24, 1), (20, 5), (20, 5)]
    got = values(spark, [(0.75,), (0.55,), (0.54,), (None,)], "t double", *[budget.depth_limit(C("t"), i) for i in ("deep_research", "freshness_sensitive", "navigational", "informational")])
    assert got == [(7, 4, 3, 5), (4, 2, 2, 3), (1, 1, 1, 1), (1, 1, 1, 1)]


def test_maintenance_is_throttled():
    assert store.due(0, 3601) and not store.due(0, 3600)


def test_extra_variants_replace_words_between_ascii_letters_only_as_sql(spark):
    cases = {
        "Übest kalt network forum": ["Übest kalt network forum research", "Übest kalt network forum explained", "Ütop kalt network forum"],
        "bestß dem network forum": ["bestß dem network forum research", "bestß dem network forum explained", "topß dem network forum"],
        "a best_ network forum": ["a best_ network forum research", "a best_ network forum explained", "a best_ distributed system forum"],
        "networ\u212ax network forum": ["networ\u212ax network forum research", "how networ\u212ax network forum works", "distributed systemx distributed system forum"],
    }
    got = values(spark, [(q,) for q in cases], "q string", search.extra_variants(C("q")))
    assert [g for (g,) in got] == list(cases.values())
