"""All registered queries of the engine and the SQL that stands against them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import html as H
from .functions import lexicons as L
from .functions import text as T
from .functions import urls as U
from .operators import budget as B
from .operators import crawl as X
from .operators import dedup as D
from .operators import ranking as R
from .operators import search as S
from .operators import signals as G
from .operators import store as K
from .plans import ranking as P
from .runtime import ship
from .schema import SearchPrefs
from .sources.tables import archive_fallback, page_records, read, spread, union_sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
C = F.col


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c, name):
    return F.round(c.cast("double"), 6).alias(name)


def quoted(words) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def pattern(p: str) -> str:
    """A pattern inside an SQL string."""
    return p.replace("'", "''").replace("\\©", "©")


def sql_count(c: str, patterns) -> str:
    return "(" + "+".join(f"len(regexp_extract_all({c}, '(?i){pattern(p)}'))" for p in patterns) + ")"


def sql_hits(c: str, patterns) -> str:
    return "(" + "+".join(f"regexp_matches({c}, '{pattern(p)}')::INT" for p in patterns) + ")"


def sql_any(c: str, parts) -> str:
    return "(" + " OR ".join(f"contains({c}, '{p}')" for p in parts) + ")"


BLANK = "' \t\n\r'"
WORDS = "list_filter(regexp_split_to_array({0}, '[ \\t\\n\\r]+'), lambda x: x <> '')"
LOWER = "list_transform(" + WORDS + ", lambda x: lower(x))"
SENTENCES = "list_filter(list_transform(regexp_split_to_array({0}, '[.!?]+'), lambda x: trim(x, " + BLANK + ")), lambda x: length(x) > 8)"
LENGTHS = "list_transform(" + SENTENCES + ", lambda s: len(list_filter(regexp_split_to_array(s, '[ \\t\\n\\r]+'), lambda x: x <> '')))"
TEXT = WORDS.format("text")
NETLOC = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))"
HOST = "regexp_replace(regexp_replace(" + NETLOC + ", ':[0-9]*$', ''), '^www\\.', '')"
PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
PLAIN = "substring(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|nav|footer|header|aside|noscript)[^>]*>.*?</(script|style|nav|footer|header|aside|noscript)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')), 1, 8000)"
CV = "(list_stddev_pop(l) / greatest(list_avg(l), 1.0))"


# pages


@query("SELECT page_id, CASE WHEN length(t) BETWEEN 3 AND 200 THEN t ELSE url END AS title FROM (SELECT page_id, url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS t FROM pages)")
def page_title_extract(spark, d):
    return read(spark, d, "pages").select("page_id", H.title(C("html"), C("url")).alias("title"))


@query(f"SELECT page_id, c AS content, len({WORDS.format('c')}) AS word_count FROM (SELECT page_id, {PLAIN} AS c FROM pages)")
def html_text_extract(spark, d):
    c = H.plain_text(C("html"))
    return spread(read(spark, d, "pages")).select("page_id", c.alias("content"), T.word_count(c).alias("word_count"))


@query(f"SELECT page_id, h AS host, CASE WHEN len(p) <= 2 THEN h WHEN array_to_string(p[-2:], '.') IN ('co.uk','org.uk','ac.uk','com.au','co.jp','co.nz','com.br') THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS registered, len(list_filter(string_split({PATH}, '/'), lambda x: x <> '')) AS depth FROM (SELECT *, {HOST} AS h, string_split({HOST}, '.') AS p FROM pages)")
def url_parts(spark, d):
    h = U.host(C("url"))
    return read(spark, d, "pages").select("page_id", h.alias("host"), U.registered_domain(h).alias("registered"), F.size(U.segments(U.path(C("url")))).alias("depth"))


KEY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '#.*$', ''), '^[a-z]+://', ''), '^www\\.', ''), '/+$', '')"


@query(f"SELECT url_key, min(page_id) AS page_id FROM (SELECT page_id, {KEY} AS url_key FROM pages) GROUP BY 1")
def url_key_dedup(spark, d):
    return D.first_of(read(spark, d, "pages").select("page_id", U.dedup_key(C("url")).alias("url_key")), "url_key", "page_id")


SLUG = f"coalesce(list_filter(string_split({PATH}, '/'), lambda x: x <> '')[-1], '')"
LINK_SCORE = f"""CASE WHEN NOT regexp_matches(url, '^https?://') OR regexp_matches(url, '{pattern(U.SKIP)}') THEN 0.0 ELSE round(least(1.0, 0.2 * CASE WHEN n = 0 THEN 0.2 WHEN n = 1 THEN 0.5 WHEN n <= 3 THEN 0.9 WHEN n <= 5 THEN 0.7 ELSE 0.4 END
 + 0.35 * CASE WHEN s = '' THEN 0.3 WHEN regexp_matches(s, '^([0-9-]+|[a-f0-9-]{{8,}})$') THEN 0.1 ELSE least(1.0, 0.7 * least(1.0, len(list_filter(regexp_split_to_array(s, '[-_.]+'), lambda x: length(x) > 2)) / 5.0) + CASE WHEN {sql_any('lower(p)', L.CONTENT_WORDS)} THEN 0.3 ELSE 0.0 END) END
 + CASE WHEN regexp_matches(p, '/[0-9]{{4}}/') THEN 0.1 ELSE 0.0 END
 + 0.15 * CASE WHEN h LIKE '%.edu' OR h LIKE '%.ac.uk' OR contains(h, '.edu.') THEN 1.0 WHEN h LIKE '%.gov' OR h LIKE '%.mil' THEN 0.9 WHEN h LIKE '%.org' THEN 0.75 WHEN h LIKE '%.net' THEN 0.65 WHEN h LIKE '%.com' THEN 0.55 ELSE 0.6 END + 0.2), 6) END"""
#: What LINK_SCORE needs of a URL.
LINK_PARTS = f"url, {PATH} AS p, len(list_filter(string_split({PATH}, '/'), lambda x: x <> '')) AS n, {SLUG} AS s, {NETLOC} AS h"


@query(f"SELECT page_id, {LINK_SCORE} AS link_score FROM (SELECT page_id, {LINK_PARTS} FROM pages)")
def link_quality_score(spark, d):
    return read(spark, d, "pages").select("page_id", r6(U.link_quality(C("url")), "link_score"))


SKIPPED = pattern(U.SKIP)


@query(f"SELECT page_id, href, NOT regexp_matches(href, '^https?://') OR regexp_matches(href, '{SKIPPED}') AS skip FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)")
def skip_links(spark, d):
    links = read(spark, d, "pages").select("page_id", F.explode(H.hrefs(C("html"))).alias("href"))
    return links.select("page_id", "href", U.skipped(C("href")).alias("skip"))


@query(f"""WITH l AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || regexp_replace(href, '#.*$', '') AS link, place FROM (SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) AS place FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)) WHERE href LIKE '/%' AND href NOT LIKE '//%'),
 k AS (SELECT page_id, link, min(place) AS place FROM l WHERE link <> regexp_replace(url, '#.*$', '') AND NOT regexp_matches(lower({PATH.replace('url', 'link')}), '{L.SITE_CHROME}') AND NOT regexp_matches(lower({PATH.replace('url', 'link')}), '{L.SITE_FILES}') AND regexp_matches({PATH.replace('url', 'link')}, '[^/]') GROUP BY 1, 2)
SELECT page_id, link FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) AS nth FROM k) WHERE nth <= 20""")
def internal_links(spark, d):
    return X.internal_links(read(spark, d, "pages"), "page_id").select("page_id", "link")


# text signals


def documents(spark, d):
    return read(spark, d, "documents").select("doc_id", "text", "source", "lang")


def texts(spark, d):
    """Documents for work on whole texts."""
    return spread(documents(spark, d))


@query(f"SELECT doc_id, len({TEXT}) AS n_words, len({SENTENCES.format('text')}) AS n_sentences FROM documents")
def word_stats(spark, d):
    return texts(spark, d).select("doc_id", T.word_count(C("text")).alias("n_words"), F.size(T.sentences(C("text"))).alias("n_sentences"))


LEX = f"list_filter({LOWER.format('text')}, lambda x: length(x) > 3 AND NOT list_contains({quoted(L.STOPWORDS)}, x))"
LEXICAL = f"CASE WHEN len({LEX}) = 0 THEN 0.0 ELSE least(0.95, len(list_distinct({LEX}))::DOUBLE / len({LEX})) END"


@query(f"SELECT doc_id, round({LEXICAL}, 6) AS diversity FROM documents")
def lexical_diversity(spark, d):
    return texts(spark, d).select("doc_id", r6(G.lexical_diversity(C("text")), "diversity"))


TECH = f"CASE WHEN len({TEXT}) = 0 THEN 0.0 ELSE least(1.0, coalesce(list_sum(list_transform({TEXT}, lambda x: CASE WHEN length(x) >= 2 AND regexp_matches(x, '\\p{{Lu}}') AND NOT regexp_matches(x, '\\p{{Ll}}') THEN 2 WHEN length(x) > 2 AND regexp_matches(x, '[0-9]') THEN 1 WHEN length(x) > 6 AND contains(x, '-') THEN 1 WHEN length(x) >= 10 THEN 1 ELSE 0 END)), 0) / len({TEXT}) / 0.10) END"


@query(f"SELECT doc_id, round({TECH}, 6) AS technical FROM documents")
def technical_vocab(spark, d):
    return texts(spark, d).select("doc_id", r6(G.technical_vocabulary(C("text")), "technical"))


def with_phrases(spark, d, *phrases):
    """Documents whose text is led by one of some phrases, as invented prose has none of them."""
    pick = F.element_at(F.array(*[F.lit(p) for p in phrases]), (C("doc_id") % len(phrases) + 1).cast("int"))
    return texts(spark, d).select("doc_id", F.concat(pick, F.lit(" "), "text").alias("text"))


def sql_phrases(*phrases) -> str:
    return f"(SELECT doc_id, {quoted(phrases)}[(doc_id % {len(phrases)} + 1)::INT] || ' ' || text AS text FROM documents)"


FILL = ("", "really quite simply", "just basically very", "perhaps")


@query(f"SELECT doc_id, round(least(0.35, len(list_filter({LOWER.format('text')}, lambda x: list_contains({quoted(L.FILLER)}, x)))::DOUBLE / greatest(len({TEXT}), 1) / 0.10 * 0.35), 7) AS penalty FROM {sql_phrases(*FILL)}")
def filler_penalty(spark, d):
    return with_phrases(spark, d, *FILL).select("doc_id", F.round(G.filler_penalty(C("text")), 7).alias("penalty"))


ALPHA = f"list_filter({LOWER.format('text')}, lambda x: regexp_matches(x, '^\\p{{L}}+$'))"
TRIGRAM = "CASE WHEN n < 40 OR len(w) < 30 THEN 0.0 ELSE least(0.30, (1 - len(list_distinct(g))::DOUBLE / len(g)) / 0.20 * 0.30) END"


@query(f"SELECT doc_id, round({TRIGRAM}, 6) AS penalty FROM (SELECT *, list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i+2], ' ')) AS g FROM (SELECT doc_id, len({TEXT}) AS n, {ALPHA} AS w FROM documents))")
def trigram_repetition(spark, d):
    return texts(spark, d).select("doc_id", r6(G.trigram_repetition(C("text")), "penalty"))


VARIANCE = f"CASE WHEN len(l) < 4 THEN 0.5 WHEN {CV} < 0.15 THEN {CV} / 0.15 * 0.3 WHEN {CV} <= 0.8 THEN 0.3 + ({CV} - 0.15) / 0.65 * 0.7 ELSE greatest(0.0, 1 - ({CV} - 0.8) * 0.5) END"


@query(f"SELECT doc_id, round({VARIANCE}, 6) AS variance FROM (SELECT doc_id, {LENGTHS.format('text')} AS l FROM documents)")
def sentence_variance(spark, d):
    return texts(spark, d).select("doc_id", r6(G.sentence_variance(C("text")), "variance"))


STRIPPED = "text"
for _p in L.BOILERPLATE:
    STRIPPED = f"regexp_replace({STRIPPED}, '(?i){pattern(_p)}', ' ', 'g')"
STRIPPED = f"trim(regexp_replace({STRIPPED}, '[ \\t\\n\\r]{{2,}}', ' ', 'g'), {BLANK})"
DENSITY = f"""SELECT doc_id, source, CASE WHEN n < 30 THEN 0.05 ELSE greatest(0.0, least(1.0, (0.25 * (1 - exp(-n / 800.0)) + 0.25 * {LEXICAL} + 0.2 * {VARIANCE} + 0.15 * {TECH} + 0.075
 - least(0.35, len(list_filter({LOWER.format('text')}, lambda x: list_contains({quoted(L.FILLER)}, x)))::DOUBLE / greatest(n, 1) / 0.10 * 0.35) - {TRIGRAM}) * least(n / 200.0, 1.0))) END AS density
FROM (SELECT *, list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i+2], ' ')) AS g FROM (SELECT *, len({TEXT}) AS n, {ALPHA} AS w, {LENGTHS.format('text')} AS l FROM (SELECT doc_id, source, {STRIPPED} AS text FROM documents)))"""


@query(f"SELECT doc_id, round(density, 6) AS density FROM ({DENSITY})")
def info_density(spark, d):
    return texts(spark, d).select("doc_id", r6(G.info_density(C("text")), "density"))


TITLES = ("Top 10 Ways to WIN BIG NOW | Best | Of", "How to fix it (2024) [really now]", "A plain title", "short", "best tools — a list", "12 tips for a title that is much longer than seventy characters in all, and then some more words")


def sql_step(n: str, two: int, a: float, b: float) -> str:
    return f"CASE WHEN {n} >= {two} THEN {a} WHEN {n} = {two - 1} THEN {b} ELSE 0.0 END"


def found(p: str) -> str:
    return f"len(regexp_extract_all(t, '{p}'))"


STUFF = f"""CASE WHEN length(t) < 8 THEN 0.0 ELSE least(1.0, {sql_step(found('[ ]*[|–—][ ]*'), 2, .55, .2)} + CASE WHEN regexp_matches(t, '(?i)\\b[0-9]{{1,2}}[ ]+(things?|ways?|tips?|tricks?|steps?|methods?|ideas?|tools?|apps?|sites?)\\b') THEN 0.25 ELSE 0 END
 + CASE WHEN length(t) > 90 THEN 0.3 WHEN length(t) > 70 THEN 0.12 ELSE 0 END + {sql_step(found('[(\\[][^)\\]]{3,30}[)\\]]'), 2, .2, .05)} + {sql_step(found('\\b[A-Z]{3,}\\b'), 3, .2, .08)} + CASE WHEN regexp_matches(t, '(?i)^(best|top|ultimate|complete|definitive|full|free|cheap)[ ]+') THEN 0.15 ELSE 0 END) END"""


@query(f"SELECT doc_id, round({STUFF}, 6) AS stuffing FROM (SELECT doc_id, {quoted(TITLES)}[(doc_id % {len(TITLES)} + 1)::INT] AS t FROM documents)")
def title_stuffing(spark, d):
    t = F.element_at(F.array(*[F.lit(x) for x in TITLES]), (C("doc_id") % len(TITLES) + 1).cast("int"))
    return documents(spark, d).select("doc_id", r6(G.title_stuffing(t), "stuffing"))


#: Some have paragraphs and headings, which no document has.
PHRASES = (
    "",
    "In conclusion, it is important to note that moreover",
    "In today's world therefore furthermore",
    "Let's dive into it, ultimately and additionally",
    "# One heading\n\nThe same words come back in each paragraph of this text\n\nThe same words come back in most paragraphs of this text\n\nSECOND HEADING\n\nOther words stand in the fourth paragraph of all\n\n",
)
PHRASE_SHARE = f"least(1.0, {sql_count('text', L.GENERIC_PHRASES)} / (greatest(len({TEXT}), 1) / 200.0) / 2)"
FLOOD = f"least(1.0, {sql_count('text', L.CONNECTIVES)} / (greatest(len({TEXT}), 1) / 80.0) / 3)"
HEADED = f"least(1.0, len(regexp_extract_all(text, '(?m)(?:^|\\n)(#{{1,4}}[ \\t\\n\\r]+.+|[A-Z][A-Z &:]{{4,40}}(?:\\n|$))')) / (greatest(len({TEXT}), 1) / 150.0))"


@query(f"SELECT doc_id, round({PHRASE_SHARE}, 6) AS phrases FROM {sql_phrases(*PHRASES)}")
def phrase_density(spark, d):
    return with_phrases(spark, d, *PHRASES).select("doc_id", r6(G.phrase_density(C("text")), "phrases"))


@query(f"SELECT doc_id, round({FLOOD}, 6) AS connectives FROM {sql_phrases(*PHRASES)}")
def connective_flood(spark, d):
    return with_phrases(spark, d, *PHRASES).select("doc_id", r6(G.connective_flood(C("text")), "connectives"))


@query(f"SELECT doc_id, round({HEADED}, 6) AS headings FROM {sql_phrases(*PHRASES)}")
def heading_density(spark, d):
    return with_phrases(spark, d, *PHRASES).select("doc_id", r6(G.heading_density(C("text")), "headings"))


PARAGRAPHS = f"list_filter(list_transform(regexp_split_to_array(text, '\\n\\n+'), lambda y: trim(y, {BLANK})), lambda y: length(y) > 30)"
BAGS = f"list_transform({PARAGRAPHS}, lambda y: list_filter(list_distinct(string_split(regexp_replace(regexp_replace(lower(y), '[^a-z ]', '', 'g'), ' +', ' ', 'g'), ' ')), lambda x: x <> '' AND NOT list_contains({quoted(L.PARAGRAPH_STOPWORDS)}, x)))"
OVERLAPS = "list_filter(list_transform(range(1, len(b)), lambda i: CASE WHEN len(b[i]) > 0 AND len(b[i + 1]) > 0 THEN len(list_intersect(b[i], b[i + 1]))::DOUBLE / len(list_distinct(list_concat(b[i], b[i + 1]))) END), lambda x: x IS NOT NULL)"
ALIKE = f"CASE WHEN len(b) < 3 THEN 0.0 ELSE least(1.0, coalesce(list_avg({OVERLAPS}), 0.0) / 0.15) END"


@query(f"SELECT doc_id, round({ALIKE}, 6) AS similarity FROM (SELECT doc_id, {BAGS} AS b FROM {sql_phrases(*PHRASES)})")
def paragraph_similarity(spark, d):
    return with_phrases(spark, d, *PHRASES).select("doc_id", r6(G.paragraph_similarity(C("text")), "similarity"))


DEPTH = f"""CASE WHEN len(c) < 2 THEN 0.5 ELSE greatest(0.0, 1 - abs(list_avg(c) - 4) / 5) END"""


@query(f"SELECT doc_id, round({DEPTH}, 6) AS depth FROM (SELECT doc_id, list_transform(list_filter(list_transform(regexp_split_to_array(text, '\\n\\n+'), lambda y: trim(y, {BLANK})), lambda y: length(y) > 20), lambda z: len({SENTENCES.format('z')})) AS c FROM {sql_phrases(*PHRASES)})")
def paragraph_depth(spark, d):
    return with_phrases(spark, d, *PHRASES).select("doc_id", r6(G.paragraph_depth(C("text")), "depth"))


UNIFORM = f"CASE WHEN len(l) < 6 OR {CV} >= 0.5 THEN 0.0 ELSE (0.5 - {CV}) / 0.5 END"


@query(f"SELECT doc_id, round({UNIFORM}, 6) AS uniformity FROM (SELECT doc_id, {LENGTHS.format('text')} AS l FROM documents)")
def sentence_uniformity(spark, d):
    return texts(spark, d).select("doc_id", r6(G.sentence_uniformity(C("text")), "uniformity"))


SPAM = f"CASE WHEN len({TEXT}) < 60 THEN 0.5 * STUFFING ELSE greatest(0.0, least(1.0, 0.15 * {UNIFORM} + 0.2 * {ALIKE} + 0.25 * {PHRASE_SHARE} + 0.1 * {HEADED} + 0.15 * {FLOOD} + 0.15 * STUFFING)) END"


@query(f"SELECT doc_id, round({SPAM.replace('STUFFING', STUFF)}, 6) AS spam FROM (SELECT doc_id, text, {LENGTHS.format('text')} AS l, {BAGS} AS b, {quoted(TITLES)}[(doc_id % {len(TITLES)} + 1)::INT] AS t FROM {sql_phrases(*PHRASES)})")
def ai_spam(spark, d):
    t = F.element_at(F.array(*[F.lit(x) for x in TITLES]), (C("doc_id") % len(TITLES) + 1).cast("int"))
    return with_phrases(spark, d, *PHRASES).select("doc_id", r6(G.ai_spam(t, C("text")), "spam"))


SALES = (
    "",
    "Best 10 picks, add to cart, affiliate, we may earn a commission",
    "$20 with a coupon code, free trial, 5 USD per month",
    "sponsored link, paid partnership and top 5 pros and cons",
    "# Best one\n# Best two\n# Best three\n# Best four\n# Best five\n",
)
SHOPS = ("example.org", "best-shop.com", "blog.net")
HEADINGS = "list_filter(list_transform(regexp_extract_all(text, '(?m)(?:^|\\n)#{1,4}[ \\t\\n\\r]+.+'), lambda h: lower(regexp_extract(h, '#{1,4}[ \\t\\n\\r]+(\\w+)', 1))), lambda x: x <> '')"
#: Needs the headings' first words as w and the domain as shop.
BIAS = f"least(1.0, CASE WHEN len(w) > 4 AND len(list_distinct(w))::DOUBLE / len(w) < 0.4 THEN least(0.4, least({sql_count('text', L.AFFILIATE)} / 3.0, 1.0) * 0.4 + 0.15) ELSE least({sql_count('text', L.AFFILIATE)} / 3.0, 1.0) * 0.4 END + least({sql_count('text', L.LISTICLE)} / 6.0, 1.0) * 0.35 + least({sql_count('text', L.PRICES)} / 6.0, 1.0) * 0.15 + CASE WHEN {sql_any('shop', L.SHOP_WORDS)} THEN 0.075 ELSE 0.0 END)"


@query(f"SELECT doc_id, round({BIAS}, 6) AS commercial FROM (SELECT *, {HEADINGS} AS w, {quoted(SHOPS)}[(doc_id % {len(SHOPS)} + 1)::INT] AS shop FROM {sql_phrases(*SALES)})")
def commercial_bias(spark, d):
    shop = F.element_at(F.array(*[F.lit(x) for x in SHOPS]), (C("doc_id") % len(SHOPS) + 1).cast("int"))
    return with_phrases(spark, d, *SALES).select("doc_id", r6(G.commercial_bias(C("text"), shop), "commercial"))


CHROME = ("Cookie policy ", "Share this article  all rights reserved", "plain", "Copyright 2024 powered by")


@query(f"SELECT doc_id, {STRIPPED} AS body FROM {sql_phrases(*CHROME)}")
def boilerplate_strip(spark, d):
    return with_phrases(spark, d, *CHROME).select("doc_id", G.strip_boilerplate(C("text")).alias("body"))


@query("SELECT o_orderkey, round(CASE WHEN a <= 0 THEN 1.0 ELSE exp(-a / 365.0) END, 6) AS freshness FROM (SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-09-01') AS a FROM orders)")
def freshness(spark, d):
    o = read(spark, d, "orders")
    return o.select("o_orderkey", r6(G.freshness(C("o_orderdate").cast("date"), F.lit("1998-09-01").cast("date")), "freshness"))


def sql_named(parts, points: int) -> str:
    return f"CASE WHEN {sql_any('d', parts)} THEN {points} ELSE 0 END"


#: Of u (URL), d (domain), t (text), b (its first 2,000 characters), all lower-cased; ties go to the first.
KIND = f"""CASE WHEN contains(d, 'wikipedia') OR contains(d, 'wikimedia') THEN 'Wiki' WHEN list_contains({quoted(L.FORUM_DOMAINS)}, d) THEN 'Forum'
 WHEN list_contains({quoted(L.ACADEMIC_DOMAINS)}, d) OR contains(d, '.edu') OR contains(d, '.ac.') THEN 'Academic' WHEN list_contains({quoted(L.NEWS_DOMAINS)}, d) THEN 'News'
 WHEN list_contains({quoted(L.DOCS_DOMAINS)}, d) OR contains(d, 'readthedocs') THEN 'Docs' WHEN list_max(p) = 0 THEN 'Unknown'
 ELSE CASE WHEN t = '' THEN ['Forum', 'Academic', 'Docs', 'News', 'Blog', 'Commercial'] ELSE ['Forum', 'Academic', 'Docs', 'News', 'Commercial', 'Blog'] END[list_position(CASE WHEN t = '' THEN [p[1], p[2], p[3], p[4], p[6], p[5]] ELSE p END, list_max(p))] END"""
KIND_POINTS = f"[{sql_hits('u', L.FORUM_URLS)} + {sql_named(L.FORUM_NAMES, 3)}, {sql_hits('u', L.ACADEMIC_URLS)} + 2 * {sql_hits('b', L.ACADEMIC_TEXT)}, {sql_hits('u', L.DOCS_URLS)}, {sql_hits('u', L.NEWS_URLS)} + {sql_named(L.NEWS_NAMES, 2)}, 2 * {sql_hits('b', L.COMMERCIAL_TEXT)} + {sql_named(L.SHOP_NAMES, 3)}, {sql_hits('b', L.BLOG_TEXT)} + {sql_named(L.BLOG_NAMES, 2)}]"


@query(f"SELECT page_id, {KIND} AS kind FROM (SELECT *, {KIND_POINTS} AS p FROM (SELECT page_id, lower(url) AS u, {HOST} AS d, {PLAIN} AS t, lower(left({PLAIN}, 2000)) AS b FROM pages))")
def content_type(spark, d):
    return spread(read(spark, d, "pages")).select("page_id", G.content_type(C("url"), H.plain_text(C("html"))).alias("kind"))


# signals relative to a set

HOSTS = f"(SELECT page_id, url, {HOST} AS domain FROM pages)"


def page_hosts(spark, d):
    return read(spark, d, "pages").select("page_id", "url", U.host(C("url")).alias("domain"), F.concat(F.lit("s"), (C("page_id") % 3).cast("string")).alias("source"))


@query(f"SELECT page_id, count(*) OVER w AS domain_n, CASE count(*) OVER w WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 WHEN 3 THEN 0.3 ELSE 0.1 END::DOUBLE AS diversity, CASE count(*) OVER w WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 WHEN 3 THEN 0.55 WHEN 4 THEN 0.35 ELSE 0.15 END::DOUBLE AS rarity FROM {HOSTS} WINDOW w AS (PARTITION BY domain)")
def domain_diversity(spark, d):
    return G.with_domain_counts(page_hosts(spark, d)).select("page_id", "domain_n", "diversity", "rarity")


@query(f"SELECT p.page_id, CASE WHEN n >= 2 THEN 0.12 ELSE 0.0 END::DOUBLE AS penalty FROM {HOSTS} p JOIN (SELECT domain, count(DISTINCT page_id % 3) AS n FROM {HOSTS} GROUP BY 1) USING (domain)")
def cross_source(spark, d):
    return G.with_domain_counts(page_hosts(spark, d)).select("page_id", C("cross_penalty").alias("penalty"))


def sql_under(c: str) -> str:
    return f"regexp_matches({c}, '\\.({'|'.join(m.replace('.', chr(92) + '.') for m in L.MAINSTREAM)})$')"


def sql_suffix(h: str) -> str:
    last = f"regexp_extract({h}, '([^.]+)$', 1)"
    last = f"CASE WHEN contains({h}, '.') THEN {last} ELSE 'com' END"
    return f"(CASE {last} {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in L.SUFFIX_WEIGHT.items())} ELSE 0.0 END + CASE WHEN length({last}) = 2 AND {last} NOT IN ('co', 'uk', 'us') THEN 0.04 ELSE 0 END)"


RARE = "CASE n WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 WHEN 3 THEN 0.55 WHEN 4 THEN 0.35 ELSE 0.15 END"
#: Of domain, url, the URL's host h split into labels (parts), n and s (rows and sources of the domain); hosts end in one-label suffixes.
SITE = f"CASE WHEN {sql_any('domain', L.COMMUNITY)} THEN 0.8 WHEN {sql_any('domain', L.PERSONAL)} THEN 0.7 ELSE 0.45 + CASE WHEN contains(coalesce(parts[-2], parts[1]), '-') THEN 0.08 ELSE 0 END + CASE WHEN len(parts) > 2 AND array_to_string(parts[1:-3], '.') NOT IN ('www', 'blog', 'en', 'm', 'mobile', 'api') THEN 0.06 ELSE 0 END END"
OBSCURE = f"""CASE WHEN list_contains({quoted(L.MAINSTREAM)}, domain) THEN 0.04 WHEN {sql_under('domain')} THEN 0.08 ELSE greatest(0.0, least(1.0, 0.4 * {SITE} + 0.1 * {sql_suffix('h')}
 + 0.15 * least(0.9, 1 - 1 / (1 + 0.4 * len(list_filter(string_split({PATH}, '/'), lambda x: x <> '' AND x <> 'index.html' AND x <> 'index.php')))) + 0.35 * {RARE} - CASE WHEN s >= 2 THEN 0.12 ELSE 0 END)) END"""


@query(f"SELECT page_id, round({OBSCURE}, 6) AS obscurity FROM (SELECT *, domain AS h, string_split(domain, '.') AS parts FROM {HOSTS}) JOIN (SELECT domain, count(*) AS n, count(DISTINCT page_id % 3) AS s FROM {HOSTS} GROUP BY 1) USING (domain)")
def obscurity(spark, d):
    p = G.with_domain_counts(page_hosts(spark, d))
    return p.select("page_id", r6(G.obscurity(C("domain"), C("url"), C("rarity"), C("cross_penalty")), "obscurity"))


FP = f"CASE WHEN len({TEXT}) >= 60 THEN left(md5(array_to_string(({LOWER.format('text')})[1:300], ' ')), 16) END"


@query(f"SELECT doc_id, CASE WHEN fp IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY fp) THEN 0.1 ELSE 0.0 END::DOUBLE AS penalty FROM (SELECT doc_id, {FP} AS fp FROM documents)")
def near_duplicate_penalty(spark, d):
    rows = texts(spark, d).select("doc_id", D.fingerprint(C("text")).alias("fp"))
    first = rows.filter("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("first"))
    return rows.join(first, "fp", "left").select("doc_id", F.when(C("doc_id") > C("first"), 0.1).otherwise(0.0).alias("penalty"))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY 2")
def exact_dedup(spark, d):
    return D.first_of(documents(spark, d).select("doc_id", F.md5("text").alias("digest")), "digest", "doc_id")


PAGE_TITLE = "CASE WHEN length(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))) BETWEEN 3 AND 200 THEN trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) ELSE url END"


def page_titles(spark, d):
    return read(spark, d, "pages").select(C("page_id").alias("pos"), U.dedup_key(C("url")).alias("url_key"), D.title_tokens(H.title(C("html"), C("url"))).alias("tokens"))


TITLE_TOKENS = f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({PAGE_TITLE}), '[^a-z0-9 ]', '', 'g'), ' +'), lambda x: x <> '' AND NOT list_contains({quoted(L.TITLE_STOPWORDS)}, x)))"


@query(f"WITH t AS (SELECT page_id, {TITLE_TOKENS} AS t FROM pages) SELECT a.page_id AS a, b.page_id AS b, round(len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))), 6) AS similarity FROM t a JOIN t b ON a.page_id < b.page_id WHERE len(a.t) > 0 AND len(b.t) > 0 AND len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) >= 0.75")
def title_jaccard_pairs(spark, d):
    return D.title_pairs(page_titles(spark, d)).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"WITH t AS (SELECT page_id, {TITLE_TOKENS} AS t FROM pages) SELECT page_id FROM t b WHERE NOT EXISTS (SELECT 1 FROM t a WHERE a.page_id < b.page_id AND len(a.t) > 0 AND len(b.t) > 0 AND len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) >= 0.75)")
def dedup_scalable(spark, d):
    t = page_titles(spark, d)
    later = D.title_pairs(t).select(C("b").alias("pos")).distinct()
    return t.join(later, "pos", "left_anti").select(C("pos").alias("page_id"))


@query(None)
def dedup_exact(spark, d):
    """The greedy rule over all pages as one list in order of page_id."""
    rows = page_titles(spark, d).withColumn("set_id", F.lit(0).cast("long"))
    return D.dedup_exact(rows, "set_id").select("set_id", "pos")


# query understanding


def user_queries(spark, d):
    """Two to five first words of each user turn stand in for a query, as there is no log of queries; null for a turn without a text."""
    c = read(spark, d, "conversations").filter("role = 'user'")
    first = F.array_join(F.slice(T.words(C("text")), F.lit(1), (C("conv_id") % 4 + 2).cast("int")), " ")
    return c.select("conv_id", "turn", F.when(C("text").isNotNull(), first).alias("q"))


SQL_QUERIES = f"(SELECT conv_id, turn, array_to_string(({TEXT})[1:(conv_id % 4 + 2)], ' ') AS q FROM conversations WHERE role = 'user')"


def sql_has(patterns) -> str:
    return f"regexp_matches(q, '(?i)(?:{'|'.join(map(pattern, patterns))})')"


@query(f"SELECT conv_id, turn, CASE WHEN trim(q) = '' THEN 'informational' WHEN {sql_has(L.FRESH)} THEN 'freshness_sensitive' WHEN len({WORDS.format('q')}) <= 4 AND {sql_has(L.NAVIGATIONAL)} THEN 'navigational' WHEN len({WORDS.format('q')}) >= 5 OR {sql_has(L.DEEP)} THEN 'deep_research' ELSE 'informational' END AS intent FROM {SQL_QUERIES}")
def intent(spark, d):
    return user_queries(spark, d).select("conv_id", "turn", S.intent(C("q")).alias("intent"))


SWAPPED = f"CASE {' '.join(f"WHEN regexp_matches(l, '{chr(92)}b{k}{chr(92)}b') THEN regexp_replace(q, '(?i){chr(92)}b{k}{chr(92)}b', '{v}', 'g')" for k, v in L.SYNONYMS.items())} END"
FRAMES = f"""list_filter([q, CASE WHEN n <= 4 AND NOT {sql_any('l', L.ACADEMIC_TRIGGERS)} THEN q || ' research' END, CASE WHEN NOT {sql_any('l', L.TECHNICAL_TRIGGERS)} THEN CASE WHEN n <= 3 THEN 'how ' || q || ' works' ELSE q || ' explained' END END,
 CASE WHEN NOT {sql_any('l', L.FORUM_TRIGGERS)} THEN q || ' discussion' END, {SWAPPED}], lambda x: x IS NOT NULL)"""
VARIANTS = f"(SELECT conv_id, turn, (CASE WHEN q = '' THEN [q] ELSE list_filter(f, lambda x, i: list_position(list_transform(f, lambda y: lower(y)), lower(x)) = i) END)[1:5] AS variants FROM (SELECT *, {FRAMES} AS f FROM (SELECT conv_id, turn, trim(q) AS q, lower(trim(q)) AS l, len({WORDS.format('q')}) AS n FROM (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'Best guide ' || q WHEN 1 THEN q || ' network forum' ELSE q END AS q FROM {SQL_QUERIES}))))"


def framed_queries(spark, d):
    """User queries, some with words that frames and substitutions look for, as invented prose has few."""
    q = F.when(C("conv_id") % 3 == 0, F.concat(F.lit("Best guide "), "q")).when(C("conv_id") % 3 == 1, F.concat("q", F.lit(" network forum"))).otherwise(C("q"))
    return user_queries(spark, d).withColumn("q", q)


@query(f"SELECT conv_id, turn, variants FROM {VARIANTS}")
def query_variants(spark, d):
    return framed_queries(spark, d).select("conv_id", "turn", S.variants(C("q")).alias("variants"))


@query(f"SELECT conv_id, turn, variants[2:4] AS extra FROM {VARIANTS}")
def extra_variants(spark, d):
    return framed_queries(spark, d).select("conv_id", "turn", S.extra_variants(C("q")).alias("extra"))


INTENTS = ("informational", "freshness_sensitive", "deep_research", "navigational")


@query("SELECT * FROM (VALUES ('informational',0.26,0.22,0.2,0.09,0.09,0.14),('freshness_sensitive',0.2258,0.1476,0.2,0.2084,0.0782,0.14),('deep_research',0.259,0.2506,0.2,0.0752,0.0752,0.14),('navigational',0.2724,0.1467,0.2,0.0943,0.1467,0.14)) t(intent, info_density, obscurity, commercial, freshness, diversity, ai_spam)")
def weights_by_intent(spark, d):
    rows = [(i, *(float(R.weights(i)[k]) for k in R.SIGNALS)) for i in INTENTS]
    return spark.createDataFrame(rows, "intent string, " + ", ".join(f"{k} double" for k in R.SIGNALS))


@query(f"""SELECT conv_id, turn, CASE WHEN len(w) < 2 THEN 0.0 WHEN len(list_filter(w, lambda x: contains(lower(t), x)))::DOUBLE / len(w) >= 0.8 AND n >= 6 THEN 0.12 WHEN len(list_filter(w, lambda x: contains(lower(t), x)))::DOUBLE / len(w) >= 0.65 AND n >= 8 THEN 0.07 ELSE 0.0 END::DOUBLE AS penalty FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(regexp_replace(lower(q), '[^\\p{{L}}\\p{{N}}_ \\t\\n\\r]', ' ', 'g'), '[ \\t\\n\\r]+'), lambda x: length(x) > 3) AS w, q || ' one two three' AS t, len({WORDS.format("(q || ' one two three')")}) AS n FROM {SQL_QUERIES})""")
def over_optimization(spark, d):
    return user_queries(spark, d).select("conv_id", "turn", R.over_optimised(F.concat("q", F.lit(" one two three")), C("q")).alias("penalty"))


# ranking

DOC_OBSCURE = OBSCURE.replace(PATH, "''").replace("CASE WHEN s >= 2 THEN 0.12 ELSE 0 END", "0")


@query(f"""WITH t AS (SELECT doc_id, source, text, {LENGTHS.format('text')} AS l, {BAGS} AS b, {HEADINGS} AS w, {FP} AS fp, count(*) OVER (PARTITION BY source) AS n FROM documents),
 s AS (SELECT doc_id, n, {SPAM.replace('STUFFING', '0.0')} AS spam, {BIAS.replace("'shop'", '§').replace('shop,', 'source,').replace('§', "'shop'")} AS sales, CASE WHEN fp IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY fp) THEN 0.1 ELSE 0.0 END AS again FROM t),
 o AS (SELECT doc_id, {DOC_OBSCURE} AS obscure FROM (SELECT doc_id, source AS domain, '' AS h, [''] AS parts, n, 1 AS s FROM t)),
 r AS (SELECT doc_id, source AS domain, round(greatest(0.0, least(1.0, 0.26 * density + 0.22 * obscure - 0.2 * sales + 0.09 * 0.5 + 0.09 * CASE n WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 WHEN 3 THEN 0.3 ELSE 0.1 END - 0.14 * spam - again)), 6) AS final FROM s JOIN o USING (doc_id) JOIN ({DENSITY}) USING (doc_id))
SELECT doc_id, domain, final FROM r ORDER BY final DESC, doc_id LIMIT 20""")
def rank_linear(spark, d):
    """The 20 best documents by all signals that the table allows and the near-duplicate penalty; it has no title, URL, date or search engine."""
    none, text = F.lit(""), C("text")
    # texts end here: what is shuffled by domain and fingerprint is narrow
    rows = texts(spark, d).select(
        C("doc_id").alias("pos"), C("source").alias("domain"), "source", G.info_density(text).alias("info_density"), G.commercial_bias(text, C("source")).alias("commercial"),
        G.ai_spam(none, text).alias("ai_spam"), D.fingerprint(text).alias("fp"), F.lit(0.5).alias("freshness"),
    )
    rows = G.with_domain_counts(rows).withColumn("obscurity", G.obscurity(C("domain"), none, C("rarity"), C("cross_penalty")))
    first = rows.select("pos", "fp").filter("fp is not null").groupBy("fp").agg(F.min("pos").alias("first"))
    again = F.when(C("pos") > C("first"), 0.1).otherwise(0.0)
    score = R.linear_score(R.weights(), again)
    return rows.join(first, "fp", "left").select(C("pos").alias("doc_id"), "domain", F.round(score, 6).alias("final")).orderBy(F.desc("final"), "doc_id").limit(20)


#: 50 neighbouring documents stand in for the results of a request, so sets stay small whatever the table's size.
DOC_RANK = "(SELECT doc_id AS pos, doc_id // 50 AS set_id, source AS domain, doc_id % 7 AS cluster, doc_id % 11 = 0 AS is_exploration, round((doc_id * 7919 % 1000) / 1000.0, 6) AS final, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id * 7919 % 1000 DESC, doc_id) AS rank FROM documents)"


def ranked_documents(spark, d):
    rows = documents(spark, d).select(C("doc_id").alias("pos"), F.floor(C("doc_id") / 50).alias("set_id"), C("source").alias("domain"), (C("doc_id") % 7).alias("cluster"), (C("doc_id") % 11 == 0).alias("is_exploration"), F.round((C("doc_id") * 7919 % 1000) / 1000.0, 6).alias("final"))
    return R.ranked(rows, by=("set_id",))


CAPPED = f"SELECT *, coalesce(turn <= 2 AND row_number() OVER (PARTITION BY set_id, turn <= 2 ORDER BY rank) <= 10, false) AS in_top FROM (SELECT *, row_number() OVER (PARTITION BY set_id, domain ORDER BY rank) AS turn FROM {DOC_RANK})"


@query(f"SELECT set_id, pos, rank FROM ({CAPPED}) WHERE in_top")
def domain_cap(spark, d):
    return R.domain_cap(ranked_documents(spark, d), "set_id").filter("in_top").select("set_id", "pos", "rank")


@query(f"SELECT * FROM (SELECT set_id, pos, row_number() OVER (PARTITION BY set_id ORDER BY turn, cluster) AS place FROM (SELECT *, row_number() OVER (PARTITION BY set_id, cluster ORDER BY final DESC, pos) AS turn FROM {DOC_RANK})) WHERE place <= 10")
def round_robin(spark, d):
    return R.round_robin(ranked_documents(spark, d), "set_id", "cluster").select("set_id", "pos", "place")


@query(f"""WITH c AS ({CAPPED}), s AS (SELECT set_id, least(greatest(2 - count(*) FILTER (in_top AND is_exploration), 0), count(*) FILTER (NOT in_top AND is_exploration), count(*) FILTER (in_top AND NOT is_exploration)) AS k FROM c GROUP BY 1),
 r AS (SELECT c.*, k, row_number() OVER (PARTITION BY set_id, in_top, is_exploration ORDER BY rank) AS up, row_number() OVER (PARTITION BY set_id, in_top, is_exploration ORDER BY final, rank) AS down FROM c JOIN s USING (set_id))
 SELECT set_id, pos FROM r WHERE (NOT in_top AND is_exploration AND up <= k) OR (in_top AND NOT is_exploration AND down > k) OR (in_top AND is_exploration)""")
def exploration_inject(spark, d):
    return R.inject_exploration(R.domain_cap(ranked_documents(spark, d), "set_id"), "set_id").filter("in_final").select("set_id", "pos")


EVENT_VOTES = "(SELECT user_id, event_id % 50 AS item, ts, event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS vote FROM events WHERE event_type IN ('purchase', 'error'))"


def votes(spark, d):
    e = read(spark, d, "events").filter("event_type in ('purchase', 'error')")
    return e.select("user_id", (C("event_id") % 50).alias("item"), F.struct("ts", "event_id").alias("at"), F.when(C("event_type") == "purchase", 1).otherwise(-1).alias("vote"))


LATEST = f"(SELECT user_id, item, arg_max(vote, (ts, event_id)) AS vote FROM {EVENT_VOTES} GROUP BY 1, 2)"


@query(f"SELECT user_id, item, vote FROM {LATEST}")
def vote_latest(spark, d):
    return K.latest(votes(spark, d), ["user_id", "item"], "at", "vote")


@query(f"SELECT item, sum(vote)::BIGINT AS votes FROM {LATEST} GROUP BY 1")
def vote_sum(spark, d):
    return K.latest(votes(spark, d), ["user_id", "item"], "at", "vote").groupBy("item").agg(F.sum("vote").alias("votes"))


@query(f"SELECT pos, round(greatest(0.0, least(1.0, final + 0.03 * sign(coalesce(votes, 0)))), 6) AS final FROM {DOC_RANK} LEFT JOIN (SELECT item, sum(vote) AS votes FROM {LATEST} GROUP BY 1) ON pos = item")
def vote_boost(spark, d):
    v = vote_sum(spark, d).withColumnRenamed("item", "pos")
    return R.vote_boost(ranked_documents(spark, d), v, "pos").select("pos", F.round("final", 6).alias("final"))


# search

TOKENS = f"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda x: length(x) > 2 AND NOT list_contains({quoted(L.CLUSTER_STOPWORDS)}, x))"
POSTS = f"(SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY 1, 2)"


@query(f"SELECT doc_id, term, tf FROM {POSTS}")
def bm25_build(spark, d):
    return S.postings(texts(spark, d), "doc_id", "text")[0].select("doc_id", "term", "tf")


TERMS = ("ing", "tion", "thst")


@query(f"""WITH p AS (SELECT * FROM {POSTS} WHERE term IN ('ing', 'tion', 'thst')), l AS (SELECT doc_id, len({TOKENS}) AS length FROM documents), n AS (SELECT count(*) AS docs, avg(length) AS mean FROM l), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
SELECT doc_id, round(sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS bm25 FROM p JOIN f USING (term) JOIN l USING (doc_id), n GROUP BY 1 HAVING count(*) = 3""")
def bm25_search(spark, d):
    return S.bm25_scan(texts(spark, d), {"text": 1.0}, list(TERMS), S.token_count).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query(f"SELECT page_id, CASE WHEN contains(t, 'that the') THEN 4.0 WHEN contains(lower(b), 'that the') THEN 2.5 WHEN contains(t, 'that') AND contains(t, 'the') THEN 1.5 ELSE 0.4 * (contains(t, 'that')::INT + contains(t, 'the')::INT) END::DOUBLE + CASE WHEN contains(lower(left(b, 300)), 'that the') THEN 0.5 ELSE 0.0 END AS boost FROM (SELECT page_id, lower({PAGE_TITLE}) AS t, {PLAIN} AS b FROM pages)")
def phrase_boost(spark, d):
    p = page_records(spark, d)
    return p.select(C("pos").alias("page_id"), S.phrase_boost(C("title"), F.lower("content").contains("that the"), "that the", F.substring("content", 1, 300)).cast("double").alias("boost"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'thst') AND contains(lower(text), 'that')")
def like_search(spark, d):
    return S.like_search(texts(spark, d), ["text"], "thst that the").select("doc_id")


@query(f"""WITH p AS (SELECT * FROM {POSTS}), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), n AS (SELECT count(*) AS docs FROM documents), r AS (SELECT doc_id, term, tf * (ln((1.0 + docs) / (1.0 + df)) + 1) AS raw FROM p JOIN f USING (term), n)
SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM r""")
def tfidf(spark, d):
    docs = texts(spark, d)
    return S.tfidf(S.postings(docs, "doc_id", "text")[0], "doc_id", docs.count()).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query("WITH q AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 100 = 0) SELECT qid, vid, round(cosine, 4) AS cosine FROM (SELECT qid, vec_id AS vid, list_dot_product(q::DOUBLE[], embedding::DOUBLE[]) AS cosine, row_number() OVER (PARTITION BY qid ORDER BY list_dot_product(q::DOUBLE[], embedding::DOUBLE[]) DESC, vec_id) AS rank FROM q JOIN embeddings ON qid <> vec_id) WHERE rank <= 5")
def dense_topk(spark, d):
    e = read(spark, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(C("vec_id").alias("qid"), C("embedding").alias("q"))
    return S.top_cosine(q, e.select(C("vec_id").alias("vid"), C("embedding").alias("v")), 5).select("qid", "vid", F.round("cosine", 4).alias("cosine"))


@query(None)
def semantic_clusters(spark, d):
    ship(spark)
    docs = texts(spark, d)
    posts, _ = S.postings(docs, "doc_id", "text")
    v = S.tfidf(posts, "doc_id", docs.count()).withColumn("set_id", F.floor(C("doc_id") / 40)).withColumnRenamed("doc_id", "pos")
    return S.clusters(v)


LINKS = "(SELECT l_partkey % 200 AS target, l_suppkey % 50 AS source, count(*) AS links FROM lineitem GROUP BY 1, 2)"


def links(spark, d):
    return read(spark, d, "lineitem").select((C("l_partkey") % 200).cast("string").alias("target"), F.concat(F.lit("s"), (C("l_suppkey") % 50).cast("string")).alias("source"))


@query(f"SELECT target::VARCHAR AS target, sum(links)::BIGINT AS links, count(*) AS domains, round(least(0.05, sum(CASE WHEN source % 10 = 0 THEN 0.5 ELSE (source % 10) / 10.0 END) * 0.02), 6) AS boost FROM {LINKS} GROUP BY 1")
def inbound_links(spark, d):
    trust = spark.range(50).filter("id % 10 <> 0").select(F.concat(F.lit("s"), C("id").cast("string")).alias("source"), (C("id") % 10 / 10.0).alias("trust"))
    return S.inbound(links(spark, d), trust).select("target", "links", "domains", r6(C("boost"), "boost"))


# store

STORE = f"(SELECT doc_id, 'u' || doc_id AS url, len({TEXT}) AS word_count, round((doc_id * 7919 % 1000) / 1000.0, 6) AS final, round((doc_id * 31 % 100) / 100.0, 6) AS ai_spam, round((doc_id * 17 % 100) / 100.0, 6) AS commercial FROM documents)"


def store_rows(spark, d):
    part = lambda k, m: F.round((C("doc_id") * k % m) / float(m), 6)
    return documents(spark, d).select("doc_id", F.concat(F.lit("u"), C("doc_id").cast("string")).alias("url"), T.word_count(C("text")).alias("word_count"), part(7919, 1000).alias("final"), part(31, 100).alias("ai_spam"), part(17, 100).alias("commercial"))


@query(f"SELECT doc_id FROM {STORE} WHERE word_count >= 80 AND final >= 0.6 AND NOT ai_spam > 0.65 AND NOT commercial > 0.75")
def store_gate(spark, d):
    return K.gate(store_rows(spark, d)).select("doc_id")


@query("SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(n.score, o.score) AS score, CASE WHEN o.doc_id IS NULL THEN 'new' ELSE 'old' END AS source FROM (SELECT doc_id, doc_id % 10 AS score FROM documents WHERE doc_id % 3 <> 0) o FULL JOIN (SELECT doc_id, 100 + doc_id % 10 AS score FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0) n ON o.doc_id = n.doc_id")
def page_upsert(spark, d):
    """Stored and new pages; every document is in one of the two at least, some in both."""
    docs = documents(spark, d)
    old = docs.filter("doc_id % 3 <> 0").select("doc_id", (C("doc_id") % 10).alias("score"), F.lit("old").alias("source"))
    new = docs.filter("doc_id % 2 = 0 or doc_id % 3 = 0").select("doc_id", (C("doc_id") % 10 + 100).alias("score"), F.lit("new").alias("source"))
    return K.upsert(old, new, "doc_id", ["score"])


AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"


@query(f"SELECT event_id FROM events WHERE ts >= {AS_OF} - INTERVAL 1 DAY * CASE WHEN event_id % 100 >= 85 THEN 30 WHEN event_id % 100 >= 70 THEN 7 ELSE 3 END")
def ttl_expire(spark, d):
    e = read(spark, d, "events").select("event_id", C("ts").cast("timestamp").alias("cached_at"), (C("event_id") % 100 / 100.0).alias("score"))
    return K.alive(e, F.lit("2024-02-01 00:00:00").cast("timestamp")).select("event_id")


@query(f"SELECT doc_id FROM {STORE} ORDER BY final, doc_id OFFSET 500")
def size_trim(spark, d):
    return K.trimmed(store_rows(spark, d), "doc_id", 500, "final", "doc_id").select("doc_id")


@query(f"SELECT count(*) AS total_pages, min(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * (doc_id * 31 % 5000)) AS oldest_cached, round(avg(final), 3) AS avg_score, count(*) FILTER (final >= 0.85) AS high_value_pages, (SELECT count(DISTINCT source) FROM documents) AS total_domains FROM {STORE}")
def store_stats(spark, d):
    at = (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=C("doc_id") * 31 % 5000)).cast("timestamp_ntz")
    pages = store_rows(spark, d).select(C("final").alias("score"), at.alias("cached_at"))
    return K.stats(pages, documents(spark, d).select("source").distinct())


@query("SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE length(text) >= 1000)")
def orphan_purge(spark, d):
    """Labels of documents that are stored; those with 1,000 characters are."""
    return read(spark, d, "labels").join(documents(spark, d).filter(F.length("text") >= 1000), "doc_id", "left_semi").select("doc_id")


MEANS = "(SELECT user_id, count(*) AS page_count, avg(value) AS avg_score, max(ts) AS last_seen FROM events GROUP BY 1)"


def means(spark, d):
    return K.domain_means(read(spark, d, "events"), "user_id", "value", "ts")


@query(f"SELECT user_id, page_count, round(avg_score, 6) AS avg_score FROM {MEANS}")
def domain_running_mean(spark, d):
    return means(spark, d).select("user_id", "page_count", F.round("avg_score", 6).alias("avg_score"))


DECAY = f"(SELECT user_id, avg_score + (0.5 - avg_score) * CASE WHEN a < 7 THEN 0.0 WHEN a < 30 THEN 0.15 WHEN a < 90 THEN 0.4 ELSE 0.65 END AS trust FROM (SELECT *, (epoch(TIMESTAMP '2024-02-06 00:00:00') - floor(epoch(last_seen))) / 86400.0 AS a FROM {MEANS}) WHERE page_count >= 2)"


@query(f"SELECT user_id, round(trust, 4) AS trust FROM {DECAY}")
def trust_decay(spark, d):
    m = means(spark, d).filter("page_count >= 2")
    return m.select("user_id", F.round(K.decayed_trust(C("avg_score"), C("last_seen").cast("timestamp"), F.lit("2024-02-06 00:00:00").cast("timestamp")), 4).alias("trust"))


#: Trust of sources by the letters of their names; a third of them is unknown.
SOURCE_TRUST = "(SELECT source, (length(source) * 7 + ascii(source)) % 100 / 100.0 AS trust FROM (SELECT DISTINCT source FROM documents) WHERE (length(source) + ascii(source)) % 3 <> 0)"


def source_trust(spark, d):
    n, a = F.length("source"), F.ascii("source")
    return documents(spark, d).select("source").distinct().filter((n + a) % 3 != 0).select("source", ((n * 7 + a) % 100 / 100.0).alias("trust"))


@query(f"SELECT CASE WHEN t >= 0.75 THEN 'high' WHEN t >= 0.55 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM (SELECT coalesce(trust, 0.5) AS t FROM documents LEFT JOIN {SOURCE_TRUST} USING (source)) GROUP BY 1")
def trust_distribution(spark, d):
    return documents(spark, d).join(source_trust(spark, d), "source", "left").select(K.trust_band(C("trust")).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


@query("SELECT lang, coalesce(source, 'unknown') AS source, count(*) AS n FROM documents GROUP BY 1, 2")
def source_histogram(spark, d):
    return documents(spark, d).groupBy("lang", F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))


FORUM = f"(list_contains({quoted(L.FORUM_HOSTS)}, domain) OR {sql_any('domain', L.FORUM_PARTS)} OR {sql_any('url', L.FORUM_PARTS)})"


@query(f"""WITH p AS (SELECT page_id, url, {HOST} AS domain, len({WORDS.format(PLAIN)}) AS n FROM pages)
SELECT page_id, 'exclude_corporate' AS filter FROM p WHERE NOT {sql_any('domain', L.CORPORATE)} UNION ALL SELECT page_id, 'forums_only' FROM p WHERE {FORUM} UNION ALL SELECT page_id, 'long_form_only' FROM p WHERE n > 800""")
def hard_filters(spark, d):
    """Pages that each of the three filters lets through."""
    rows = page_records(spark, d).select(C("pos").alias("page_id"), "url", "domain", "word_count")
    kept = [P.filtered(rows, SearchPrefs("q", **{name: True})).select("page_id", F.lit(name).alias("filter")) for name in ("exclude_corporate", "forums_only", "long_form_only")]
    return reduce(DataFrame.unionByName, kept)


@query("SELECT left(sha256(lower(trim(event_type))), 32) AS query_hash, arg_min(event_type, (ts, event_type)) AS query, arg_max(user_id::VARCHAR, (ts, user_id::VARCHAR)) AS intent, count(*) AS search_count FROM events GROUP BY 1")
def query_memory(spark, d):
    log = read(spark, d, "events").select(C("event_type").alias("query"), C("user_id").cast("string").alias("intent"), "ts")
    return K.query_memory(log).select("query_hash", "query", "intent", "search_count")


@query(f"SELECT DISTINCT q AS query FROM {SQL_QUERIES} WHERE 1 - levenshtein(lower(q), 'the of') / greatest(length(q), 6, 1)::DOUBLE >= 0.5 OR contains(lower(q), 'the of') OR contains('the of', lower(q))")
def similar_queries(spark, d):
    return S.similar_queries(user_queries(spark, d).select(C("q").alias("query")), "the of", 0.5).select("query").distinct()


@query("SELECT doc_id, (list_distinct_tags)[1:3] AS tags FROM (SELECT doc_id, CASE WHEN source = lang THEN [lang] ELSE [lang, source] END AS list_distinct_tags FROM documents)")
def query_tags(spark, d):
    return documents(spark, d).select("doc_id", K.add_tag(F.array("lang"), C("source"), 3).alias("tags"))


# budget


@query("SELECT c_custkey, CASE WHEN t >= 0.75 THEN 7 WHEN t >= 0.55 THEN 4 ELSE 1 END AS depth FROM (SELECT c_custkey, c_custkey % 100 / 100.0 AS t FROM customer)")
def depth_limit(spark, d):
    return read(spark, d, "customer").select("c_custkey", B.depth_limit(C("c_custkey") % 100 / 100.0, "deep_research").alias("depth"))


#: A customer is a request, its orders ask for pages of three domains.
REQUESTS = "(SELECT o_custkey AS set_id, o_orderkey % 3 AS domain, o_orderkey AS pos, o_orderkey % 4 + 1 AS want, 6 AS limit_ FROM orders)"


def page_requests(spark, d):
    return read(spark, d, "orders").select(C("o_custkey").alias("set_id"), (C("o_orderkey") % 3).alias("domain"), C("o_orderkey").alias("pos"), (C("o_orderkey") % 4 + 1).alias("want"), F.lit(6).cast("long").alias("limit"))


@query(f"""WITH a AS (SELECT *, sum(want) OVER (PARTITION BY set_id, domain ORDER BY pos) AS cum FROM {REQUESTS}), b AS (SELECT *, least(limit_, cum) - least(limit_, cum - want) AS c FROM a), e AS (SELECT *, sum(c) OVER (PARTITION BY set_id ORDER BY pos) AS t FROM b)
SELECT pos, (least(25, t) - least(25, t - c))::BIGINT AS granted FROM e""")
def budget_allocate(spark, d):
    return B.allocate(page_requests(spark, d), "set_id", 25).select("pos", C("granted").cast("long").alias("granted"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 100 < 50 ORDER BY md5(c_custkey::VARCHAR || '0') LIMIT 25")
def exploration_sample(spark, d):
    return B.exploration_sample(read(spark, d, "customer").select("c_custkey", (C("c_custkey") % 100 / 100.0).alias("trust")), "c_custkey", 25).select("c_custkey")


@query("SELECT domain, pos FROM (SELECT o_custkey AS domain, o_orderkey AS pos, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def seed_one_per_domain(spark, d):
    rows = read(spark, d, "orders").select(C("o_custkey").alias("domain"), C("o_orderkey").alias("pos"), C("o_totalprice").alias("priority"))
    return B.one_per_domain(rows).select("domain", "pos")


@query(f"SELECT doc_id, CASE WHEN n < 150 THEN n + 2 ELSE n END AS word_count, n < 150 AS archive_used FROM (SELECT doc_id, len({TEXT}) AS n FROM documents)")
def archive_fallback_(spark, d):
    docs = documents(spark, d).select("doc_id", C("text").alias("content"), T.word_count(C("text")).alias("word_count"))
    archive = docs.select("doc_id", F.concat("content", F.lit(" two more")).alias("content"), (C("word_count") + 2).alias("word_count"))
    return archive_fallback(docs, archive, "doc_id").select("doc_id", "word_count", "archive_used")


QUERIES["archive_fallback"] = QUERIES.pop("archive_fallback_")
ORACLES["archive_fallback"] = ORACLES.pop("archive_fallback_")


@query("SELECT conv_id, list(text ORDER BY turn) AS comments FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 5 AND role = 'assistant') WHERE r2 <= 3 GROUP BY 1")
def comment_topk(spark, d):
    five = F.slice(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), 1, 5)
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(five.alias("c"))
    said = F.transform(F.slice(F.filter("c", lambda x: x["role"] == "assistant"), 1, 3), lambda x: x["text"])
    return rows.select("conv_id", said.alias("comments")).filter(F.size("comments") > 0)


@query("SELECT doc_id, 0 AS src_order FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id % 2 = 1")
def union_in_order(spark, d):
    docs = documents(spark, d).select("doc_id")
    return union_sources(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")).select("doc_id", "src_order")
