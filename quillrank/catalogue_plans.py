"""Registered queries of sources, store, crawl and the whole ranking, with their SQL where SQL can express them.

Tables that the engine would keep (requests, trust, votes, landed responses) are stood in for by whole test tables; each
query says how. Requests are sets of 40 neighbouring pages, so a request is small whatever the table's size.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import AS_OF, BIAS, C, DENSITY, FLOOD, FP, HEADED, HEADINGS, HOST, KIND, KIND_POINTS, LATEST, LENGTHS, LINK_PARTS, LINK_SCORE, NETLOC, OBSCURE, PAGE_TITLE, PATH, PHRASE_SHARE, PLAIN, REQUESTS, SPAM, STORE, STUFF, TEXT, WORDS, BAGS, documents, means, page_requests, quoted, r6, ranked_documents, query, source_trust, SOURCE_TRUST, sql_any, store_rows, votes, pattern
from .functions import html as H
from .functions import lexicons as L
from .functions import text as T
from .functions import urls as U
from .operators import budget as B
from .operators import crawl as X
from .operators import ranking as R
from .operators import search as S
from .operators import signals as G
from .operators import store as K
from .plans import ranking as P
from .schema import SearchPrefs
from .sources import records
from .sources.tables import page_records, read, spread

W_PLAIN = WORDS.format("c")

# sources


@query(f"SELECT page_id, title, url, left(c, 200) AS snippet, CASE WHEN contains(h, '.') THEN array_to_string(string_split(h, '.')[-2:], '.') ELSE h END AS domain, 'landed' AS source, 0 AS word_count FROM (SELECT page_id, url, {PAGE_TITLE} AS title, {PLAIN} AS c, {HOST} AS h FROM pages)")
def base_records(spark, d):
    """Base records of pages; test hosts end in suffixes of one label."""
    p = spread(read(spark, d, "pages"))
    rows = p.select("page_id", "url", H.title(C("html"), C("url")).alias("t"), F.substring(H.plain_text(C("html")), 1, 200).alias("s"))
    return rows.select("page_id", *records.record(C("url"), C("t"), C("s"), "landed")).drop("content", "publish_date", "author")


ANSWERS = "SELECT page_id // 20 AS query_id, row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id) - 1 AS pos, page_id, url FROM pages"


def answers(spark, d):
    """Twenty neighbouring pages are one landed response."""
    return read(spark, d, "pages").withColumn("query_id", F.floor(C("page_id") / 20))


@query(f"SELECT query_id, pos, url, 'Title ' || page_id AS title, 'Text of ' || page_id AS snippet, page_id % 9 || ' days ago' AS publish_date FROM ({ANSWERS}) WHERE pos < 15")
def api_results(spark, d):
    item = F.struct("page_id", C("url").alias("url"), F.concat(F.lit("Title "), "page_id").alias("title"), F.concat(F.lit("Text of "), "page_id").alias("description"), F.concat(C("page_id") % 9, F.lit(" days ago")).alias("age"))
    body = F.to_json(F.struct(F.struct(F.array_sort(F.collect_list(item)).alias("results")).alias("web")))
    landed = answers(spark, d).groupBy("query_id").agg(body.alias("body"))
    return records.api_results(landed).select("query_id", C("pos").cast("long").alias("pos"), "url", "title", "snippet", "publish_date")


@query(f"SELECT query_id, pos, url, 'A & B ' || page_id AS title, 'Some text ' || page_id AS snippet FROM ({ANSWERS}) WHERE pos < 15")
def html_results(spark, d):
    """Result pages whose links go through a redirect for every second result."""
    link = F.when(C("page_id") % 2 == 0, F.concat(F.lit("//duckduckgo.com/l/?kh=-1&amp;uddg="), F.url_encode("url"))).otherwise(F.replace("url", F.lit("&"), F.lit("&amp;")))
    block = F.concat(F.lit('<div class="result"><a class="result__a" href="'), link, F.lit('">A &amp; <b>B</b> '), "page_id", F.lit('</a><a class="result__snippet">Some <b>text</b> '), "page_id", F.lit("</a></div>"))
    landed = answers(spark, d).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", block.alias("b")))), lambda x: x["b"]), "\n").alias("body"))
    return records.result_pages(landed).select("query_id", C("pos").cast("long").alias("pos"), "url", "title", "snippet")


THREADS = "SELECT conv_id // 20 AS query_id, conv_id, row_number() OVER (PARTITION BY conv_id // 20 ORDER BY conv_id) - 1 AS pos, min_by(text, turn) AS text FROM conversations GROUP BY conv_id"


@query(f"SELECT query_id, pos, '[r/c' || conv_id % 5 || '] Thread ' || conv_id AS title, 'https://www.reddit.com/t/' || conv_id AS url, CASE WHEN length(t) > 200 THEN left(t, 200) || '…' WHEN t = '' THEN 'Thread ' || conv_id ELSE t END AS snippet, len({WORDS.format('t')}) AS word_count FROM (SELECT *, trim(text, ' \t\n\r') AS t FROM ({THREADS})) WHERE pos < 10")
def thread_results(spark, d):
    """The first turn of each conversation is a thread's text."""
    first = read(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    data = F.struct(F.concat(F.lit("/t/"), "conv_id").alias("permalink"), F.concat(F.lit("r/c"), C("conv_id") % 5).alias("subreddit_name_prefixed"), F.concat(F.lit("Thread "), "conv_id").alias("title"), C("text").alias("selftext"), F.lit(1).alias("score"), C("conv_id").cast("string").alias("id"), F.lit("a").alias("author"))
    landed = first.groupBy(F.floor(C("conv_id") / 20).alias("query_id")).agg(F.to_json(F.struct(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", data.alias("data")))), lambda x: F.struct(x["data"].alias("data"))).alias("children")).alias("data"))).alias("body"))
    return records.thread_results(landed).select("query_id", C("pos").cast("long").alias("pos"), "title", "url", "snippet", "word_count")


COMMENT = "trim(text, ' \t\n\r')"


@query(f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations), c AS (SELECT conv_id, {COMMENT} AS t, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM f WHERE r BETWEEN 2 AND 6 AND length(text) % 7 > 2 AND {COMMENT} <> ''),
 s AS (SELECT conv_id, string_agg(t, chr(10) || chr(10) ORDER BY turn) AS said FROM c WHERE k <= 3 GROUP BY 1)
SELECT f.conv_id, CASE WHEN said IS NULL THEN f.text ELSE trim(f.text || chr(10) || chr(10) || said, ' \t\n\r') END AS content FROM f LEFT JOIN s USING (conv_id) WHERE r = 1""")
def thread_comments(spark, d):
    """The first turn is a thread, the others are comments whose score is the length of their text modulo 7."""
    c = read(spark, d, "conversations")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("content"), F.min("turn").alias("first")).withColumn("word_count", T.word_count(C("content")))
    rest = c.join(first.select("conv_id", "first"), "conv_id").filter(C("turn") > C("first")).select("conv_id", C("turn").alias("pos"), C("text").alias("body"), (F.length("text") % 7).alias("score"))
    return records.with_comments(first.drop("first"), rest, "conv_id").select("conv_id", "content")


@query(f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://x.org/?q=1' END AS target FROM pages")
def redirect_unwrap(spark, d):
    wrapped = F.when(C("page_id") % 2 == 0, F.concat(F.lit("/l/?kh=-1&uddg="), F.url_encode("url"))).otherwise("https://x.org/?q=1")
    return read(spark, d, "pages").select("page_id", U.unwrapped(wrapped).alias("target"))


DATE_FORMS = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss'+0000'", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy", "'on' yyyy")


@query("SELECT o_orderkey, CASE o_orderkey % 10 WHEN 9 THEN NULL WHEN 8 THEN date_trunc('year', o_orderdate::TIMESTAMP) ELSE o_orderdate::TIMESTAMP END AS at FROM orders")
def date_parse(spark, d):
    """Order dates written in nine of the ten formats and in one that isn't known."""
    o = read(spark, d, "orders").select("o_orderkey", C("o_orderdate").cast("timestamp").alias("t"))
    text = F.lit(None).cast("string")
    for k, form in enumerate(DATE_FORMS):
        text = F.when(C("o_orderkey") % 10 == k, F.date_format("t", form)).otherwise(text)
    return o.select("o_orderkey", G.parsed_date(text).cast("timestamp_ntz").alias("at"))


@query(f"SELECT page_id, regexp_replace(url, '#.*$', '') AS bare, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS base, {NETLOC} AS netloc FROM pages")
def url_forms(spark, d):
    return read(spark, d, "pages").select("page_id", U.without_fragment(C("url")).alias("bare"), U.base(C("url")).alias("base"), U.authority(C("url")).alias("netloc"))


@query("SELECT doc_id, '[\"' || lang || '\",\"' || source || '\"]' AS tags, [lang, source] AS parsed FROM documents")
def json_tags(spark, d):
    tags = F.to_json(F.array("lang", "source"))
    return documents(spark, d).select("doc_id", tags.alias("tags"), F.from_json(tags, "array<string>").alias("parsed"))


@query(f"SELECT conv_id, turn, trim(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_ \\t\\n\\r]', ' ', 'g'), ' ') AS clean FROM conversations")
def query_sanitise(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace("text", "[^\\p{L}\\p{N}_ \\t\\n\\r]", " ")).alias("clean"))


# links

LINKS = """(SELECT page_id, url, place, CASE WHEN href LIKE 'http%' THEN href ELSE regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || href END AS link FROM (SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) AS place FROM (SELECT p.page_id, p.url, regexp_extract_all(p.html, 'href="([^"]*)"', 1) || CASE WHEN q.url IS NULL THEN [] ELSE [q.url] END AS h FROM pages p LEFT JOIN pages q ON q.page_id = p.page_id + 40)) WHERE href LIKE '/%' OR href LIKE 'http%')"""


def linked_pages(spark, d):
    """Pages with one more link each, without text, to the page 40 ids on: their own links lead to no page that is there."""
    p = read(spark, d, "pages").select("page_id", "url", "html")
    to = p.select((C("page_id") - 40).alias("page_id"), C("url").alias("to"))
    more = F.when(C("to").isNotNull(), F.concat(F.lit('<a href="'), "to", F.lit('"></a>'))).otherwise("")
    return p.join(to, "page_id", "left").select("page_id", "url", F.concat(T.safe(C("html")), more).alias("html"))


def landed_pages(spark, d):
    """linked_pages, and the same pages again under the URL of their first link."""
    p = linked_pages(spark, d).select("url", "html")
    first = U.resolve(C("url"), F.regexp_extract("html", 'href="([^"]*)"', 1))
    return p.unionByName(p.select(first.alias("url"), "html"))


LINK_HOST = HOST.replace("regexp_extract(url", "regexp_extract(link")


@query(f"""WITH l AS (SELECT page_id, link, min(place) AS place FROM {LINKS} WHERE {LINK_HOST} <> {HOST} AND NOT regexp_matches(link, '{pattern(U.SKIP)}') GROUP BY 1, 2)
SELECT page_id, link, nth FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) AS nth FROM l) WHERE nth <= 60""")
def outbound_links(spark, d):
    return X.outbound_links(linked_pages(spark, d), "page_id").select("page_id", "link", C("nth").cast("long").alias("nth"))


@query(f"SELECT page_id, link, nth FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) AS nth FROM {LINKS} WHERE {LINK_HOST} = {HOST}) WHERE nth <= 80")
def site_links(spark, d):
    return X.site_links(linked_pages(spark, d), "page_id").select("page_id", "link", C("nth").cast("long").alias("nth"))


@query(f"SELECT page_id, url AS link, score FROM (SELECT page_id, url, {LINK_SCORE} AS score FROM (SELECT page_id, {LINK_PARTS} FROM (SELECT DISTINCT page_id, link AS url FROM {LINKS}))) WHERE score >= 0.3")
def scored_links(spark, d):
    links = X.links_of(linked_pages(spark, d), "page_id").select("page_id", "link").distinct()
    rows = links.withColumn("score", U.link_quality(C("link"))).filter(C("score") >= 0.3)
    return rows.select("page_id", "link", r6(C("score"), "score"))


def page_trust(spark, d):
    """Trust of a page's host by the length of its name; a third of the hosts is unknown."""
    h = read(spark, d, "pages").select(U.host(C("url")).alias("domain")).distinct()
    return h.filter(F.length("domain") % 3 != 0).select("domain", (F.length("domain") * 7 % 100 / 100.0).alias("trust"))


def page_results(spark, d):
    """Results of requests: 40 neighbouring pages, the third of which came from another source."""
    p = linked_pages(spark, d)
    links = X.outbound_links(p, "page_id").groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "link"))), lambda x: x["link"]).alias("outbound_links"))
    text = H.plain_text(C("html"))
    rows = spread(p).select("page_id", "url", H.title(C("html"), C("url")).alias("title"), text.alias("content")).join(links, "page_id", "left")
    return rows.select(
        F.floor(C("page_id") / 40).alias("query_id"), C("page_id").alias("pos"), "url", U.host(C("url")).alias("domain"), "title", F.substring("content", 1, 300).alias("snippet"), "content", T.word_count(C("content")).alias("word_count"),
        F.when(C("page_id") % 3 == 0, F.concat(F.lit("2024-01-"), F.lpad((C("page_id") % 28 + 1).cast("string"), 2, "0"))).alias("publish_date"), F.when(C("page_id") % 5 == 0, "someone").alias("author"),
        F.concat(F.lit("s"), (C("page_id") % 3).cast("string")).alias("source"), F.lit(False).alias("from_cache"), (C("page_id") % 13 == 0).alias("is_exploration"), "outbound_links",
    )


DAY = "2024-02-01 00:00:00"
QUESTION = "the nicht with"


def page_scores(spark, d):
    return P.scored(page_results(spark, d), page_trust(spark, d), R.weights(), F.lit(QUESTION), F.lit(DAY).cast("timestamp"))


RESULTS = f"(SELECT page_id // 40 AS query_id, page_id AS pos, url, {HOST} AS domain, {PAGE_TITLE} AS title, {PLAIN} AS text, page_id % 3 AS src, CASE WHEN page_id % 3 = 0 THEN DATE '2024-01-01' + (page_id % 28)::INT END AS day, CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END AS signed FROM pages)"
ALL_TEXT = "(text || ' ' || left(text, 300) || ' ' || title || ' ' || url)"
P_BIAS = BIAS.replace("regexp_extract_all(text, '(?i)", f"regexp_extract_all({ALL_TEXT}, '(?i)").replace("shop,", "domain,")
P_DENSITY = DENSITY.replace("SELECT doc_id, source, CASE", "SELECT pos, CASE").replace("SELECT doc_id, source, ", "SELECT pos, ").replace("FROM documents", f"FROM {RESULTS}")
P_KIND = KIND_POINTS.rsplit("]", 1)[0] + " + signed]"


@query(f"""WITH r AS (SELECT *, title AS t, lower(title) AS lt, string_split(domain, '.') AS parts, domain AS h, {LENGTHS.format('text')} AS l, {BAGS} AS b, {HEADINGS} AS w, {FP} AS fp, count(*) OVER d AS n, len(list(DISTINCT src) OVER d) AS s FROM {RESULTS} WINDOW d AS (PARTITION BY query_id, domain)),
 x AS (SELECT query_id, pos, domain, n, {SPAM.replace('STUFFING', STUFF)} AS spam, {P_BIAS} AS sales, {OBSCURE} AS obscure, CASE WHEN day IS NULL THEN 0.5 ELSE exp(-(DATE '2024-02-01' - day) / 365.0) END AS fresh,
  CASE WHEN fp IS NOT NULL AND pos > min(pos) OVER (PARTITION BY query_id, fp) THEN 0.1 ELSE 0.0 END AS again,
  CASE WHEN (contains(lt, 'nicht')::INT + contains(lt, 'with')::INT) / 2.0 >= 0.8 AND len({WORDS.format('title')}) >= 6 THEN 0.12 WHEN (contains(lt, 'nicht')::INT + contains(lt, 'with')::INT) / 2.0 >= 0.65 AND len({WORDS.format('title')}) >= 8 THEN 0.07 ELSE 0.0 END AS over FROM r)
SELECT query_id, pos, round(greatest(0.0, least(1.0, 0.26 * density + 0.22 * obscure - 0.2 * sales + 0.09 * fresh + 0.09 * CASE n WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 WHEN 3 THEN 0.3 ELSE 0.1 END - 0.14 * spam - again - over + CASE WHEN length(domain) % 3 <> 0 THEN (length(domain) * 7 % 100 / 100.0 - 0.5) * 0.08 ELSE 0 END)), 3) AS final,
 round(density, 3) AS info_density, round(obscure, 3) AS obscurity, round(sales, 3) AS commercial, round(spam, 3) AS ai_spam FROM x JOIN ({P_DENSITY}) USING (pos)""")
def rank_scores(spark, d):
    """All six signals of every page in its request, with trust, over-optimisation and near-duplicate penalty."""
    return page_scores(spark, d).select("query_id", "pos", "final", "info_density", "obscurity", "commercial", "ai_spam")


def url_votes(spark, d):
    """Votes for every eleventh page, up and down."""
    return read(spark, d, "pages").filter("page_id % 11 = 0").select("url", F.when(C("page_id") % 2 == 0, 1).otherwise(-1).cast("long").alias("votes"))


@query(None)
def rank_results(spark, d):
    """The whole ranking of every request: scores, link boost, clusters, domain cap, exploration, votes."""
    rows = P.reordered(page_scores(spark, d), page_trust(spark, d), url_votes(spark, d))
    return rows.select("query_id", "pos", "rank", "final", "cluster", "cluster_id", "cluster_label", "trust_boost", "feedback_vote")


@query(None)
def cluster_labels(spark, d):
    """Clusters of each request's pages by their titles and texts, with their labels and places."""
    rows = page_results(spark, d).select("query_id", "pos", "url", "title", "snippet", F.round(F.pmod(F.xxhash64("pos"), F.lit(1000)) / 1000.0, 3).alias("final"))
    return S.cluster_results(R.ranked(rows, ("query_id",)))


@query(None)
def link_boost(spark, d):
    return S.inbound_of_head(page_results(spark, d).select("query_id", "domain", "outbound_links"), page_trust(spark, d))


TRUSTED = f"(SELECT DISTINCT {HOST} AS domain, length({HOST}) * 7 % 100 / 100.0 AS trust FROM pages WHERE length({HOST}) % 3 <> 0)"


@query(f"SELECT page_id, round(coalesce((trust - 0.5) * 0.08, 0.0), 6) AS shift FROM (SELECT page_id, {HOST} AS domain FROM pages) LEFT JOIN {TRUSTED} USING (domain)")
def trust_shift(spark, d):
    p = read(spark, d, "pages").select("page_id", U.host(C("url")).alias("domain"))
    return p.join(page_trust(spark, d), "domain", "left").select("page_id", r6(R.trust_shift(C("trust")), "shift"))


DOC_RANK = "(SELECT doc_id AS pos, doc_id // 50 AS set_id, source AS domain, doc_id % 11 = 0 AS x, round((doc_id * 7919 % 1000) / 1000.0, 6) AS final, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id * 7919 % 1000 DESC, doc_id) AS rank FROM documents)"


@query(f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY set_id, domain ORDER BY rank) AS turn FROM {DOC_RANK}), b AS (SELECT *, CASE WHEN turn <= 2 THEN row_number() OVER (PARTITION BY set_id, turn <= 2 ORDER BY rank) END AS slot FROM a),
 c AS (SELECT *, coalesce(slot <= 10, false) AS top FROM b), k AS (SELECT set_id, least(greatest(2 - count(*) FILTER (top AND x), 0), count(*) FILTER (NOT top AND x), count(*) FILTER (top AND NOT x)) AS k FROM c GROUP BY 1),
 e AS (SELECT c.*, k, row_number() OVER (PARTITION BY set_id, top, x ORDER BY rank) AS up, row_number() OVER (PARTITION BY set_id, top, x ORDER BY final, rank) AS down FROM c JOIN k USING (set_id)),
 f AS (SELECT e.*, NOT top AND x AND up <= k AS came, top AND NOT x AND down <= k AS went FROM e), g AS (SELECT f.*, CASE WHEN came THEN w.slot ELSE f.slot END AS place FROM f LEFT JOIN (SELECT set_id AS sid, down AS d, slot FROM f WHERE went) w ON came AND sid = f.set_id AND d = f.up)
SELECT set_id, pos, row_number() OVER (PARTITION BY set_id ORDER BY CASE WHEN went THEN 2 WHEN top OR came THEN 0 ELSE 1 END, CASE WHEN (top OR came) AND NOT went AND k > 0 THEN -final ELSE 0 END, CASE WHEN went THEN down WHEN top OR came THEN place ELSE rank END) AS blended FROM g""")
def blend_order(spark, d):
    return R.blend(ranked_documents(spark, d), "set_id").select("set_id", "pos", "blended")


@query(f"""WITH v AS (SELECT item AS pos, sum(vote) AS votes FROM {LATEST} GROUP BY 1), j AS (SELECT set_id, pos, rank, coalesce(votes, 0) AS v, CASE WHEN coalesce(votes, 0) <> 0 THEN round(greatest(0.0, least(1.0, final + 0.03 * sign(votes))), 3) ELSE final END AS final FROM {DOC_RANK} LEFT JOIN v USING (pos))
SELECT set_id, pos, final, row_number() OVER (PARTITION BY set_id ORDER BY CASE WHEN any_vote THEN -final ELSE 0 END, rank) AS voted FROM (SELECT *, bool_or(v <> 0) OVER (PARTITION BY set_id) AS any_vote FROM j)""")
def vote_order(spark, d):
    v = K.latest(votes(spark, d), ["user_id", "item"], "at", "vote").groupBy(C("item").alias("pos")).agg(F.sum("vote").alias("votes"))
    return R.vote_order(ranked_documents(spark, d), v, "pos", "set_id").select("set_id", "pos", "final", "voted")


@query("WITH e AS (SELECT vec_id // 20 AS set_id, vec_id, embedding FROM embeddings) SELECT a.set_id, a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine FROM e a JOIN e b ON a.set_id = b.set_id AND a.vec_id < b.vec_id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.2")
def cosine_pairs(spark, d):
    """Pairs of near vectors in sets of 20 neighbours, which stand in for a request's results."""
    e = read(spark, d, "embeddings").select(F.floor(C("vec_id") / 20).alias("set_id"), C("vec_id").alias("id"), C("embedding").alias("v"))
    return S.cosine_pairs(e, "set_id", 0.2).select("set_id", "a", "b", F.round("cosine", 4).alias("cosine"))


@query(f"SELECT target::VARCHAR AS target, round(least(0.05, round(sum(CASE WHEN source % 10 = 0 THEN 0.5 ELSE (source % 10) / 10.0 END) * 0.02, 4)), 6) AS boost FROM (SELECT DISTINCT l_partkey % 200 AS target, l_suppkey % 50 AS source FROM lineitem WHERE l_quantity >= 48) GROUP BY 1")
def authority_boost(spark, d):
    """Parts are linked to by the suppliers of their large orders."""
    links = read(spark, d, "lineitem").filter("l_quantity >= 48").select((C("l_partkey") % 200).cast("string").alias("target"), F.concat(F.lit("s"), (C("l_suppkey") % 50).cast("string")).alias("source"))
    trust = spark.range(50).filter("id % 10 <> 0").select(F.concat(F.lit("s"), C("id").cast("string")).alias("source"), (C("id") % 10 / 10.0).alias("trust"))
    return S.inbound(links, trust).select("target", r6(C("boost"), "boost"))


# search

ASKED = "tion the"


@query(f"""WITH p AS (SELECT page_id, url, {PAGE_TITLE} AS title, {PLAIN} AS c FROM pages), q AS (SELECT *, lower(title) AS t, lower(left(title || ' ' || c, 8000)) AS b FROM p),
 f AS (SELECT *, len(regexp_extract_all(t, '[a-z0-9]+')) + len(regexp_extract_all(b, '[a-z0-9]+')) AS n, {', '.join(f"5.0 * len(list_filter(regexp_split_to_array(t, '[^a-z0-9]+'), lambda x: x = '{w}')) + len(list_filter(regexp_split_to_array(b, '[^a-z0-9]+'), lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(sorted(set(ASKED.split()))))} FROM q),
 s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM f),
 g AS (SELECT f.*, {' + '.join(f"greatest(ln((docs - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(2))} AS bm25, regexp_matches(t, '(^|[^a-z0-9])tion[^a-z0-9]+the($|[^a-z0-9])') OR regexp_matches(b, '(^|[^a-z0-9])tion[^a-z0-9]+the($|[^a-z0-9])') AS near FROM f, s WHERE f0 > 0 AND f1 > 0),
 o AS (SELECT *, row_number() OVER (ORDER BY bm25 DESC, url) AS r, row_number() OVER (PARTITION BY near ORDER BY bm25 DESC, url) AS nr FROM g),
 h AS (SELECT *, CASE WHEN contains(t, 'tion the') THEN 4.0 WHEN near AND nr <= 15 THEN 2.5 WHEN contains(t, 'tion') AND contains(t, 'the') THEN 1.5 ELSE 0.4 * (contains(t, 'tion')::INT + contains(t, 'the')::INT) END + CASE WHEN contains(lower(left(c, 300)), 'tion the') THEN 0.5 ELSE 0 END AS boost FROM o WHERE r <= 30)
SELECT * FROM (SELECT url, round(bm25, 5) AS bm25, round(boost, 2)::DOUBLE AS boost, row_number() OVER (ORDER BY boost DESC, bm25 DESC, url) AS place FROM h) WHERE place <= 15""")
def search_pages(spark, d):
    """The local search for one query: all words, twice the limit by bm25, then boosts."""
    p = page_records(spark, d).select("url", "title", "content", F.substring("content", 1, 300).alias("snippet"))
    return S.search_pages(p, ASKED).select("url", F.round("bm25", 5).alias("bm25"), F.round("boost", 2).alias("boost"), C("place").cast("long").alias("place"))


@query(f"SELECT page_id FROM (SELECT page_id, lower({PAGE_TITLE}) AS t, lower({PLAIN}) AS c FROM pages) WHERE (contains(t, 'tion') OR contains(c, 'tion')) AND (contains(t, 'that') OR contains(c, 'that')) ORDER BY length(c) DESC, page_id LIMIT 15")
def like_pages(spark, d):
    """The search without an index: best 15 by length."""
    p = page_records(spark, d).withColumn("n", F.length("content"))
    return S.like_search(p, ["title", "content"], "the tion that", 15, (F.desc("n"), "pos")).select(C("pos").alias("page_id"))


# store


@query(f"SELECT doc_id, 'u' || doc_id AS url, source AS domain, 'cache' AS source, true AS from_cache FROM documents WHERE source = 'site3.example.org' OR length(text) > 500")
def page_results_stored(spark, d):
    """Stored pages as results."""
    null = F.lit(None).cast("string")
    p = documents(spark, d).filter((C("source") == "site3.example.org") | (F.length("text") > 500))
    rows = p.select("doc_id", F.concat(F.lit("u"), "doc_id").alias("url"), C("source").alias("domain"), null.alias("title"), null.alias("snippet"), null.alias("content"), F.lit(0).alias("word_count"), null.alias("publish_date"), null.alias("author"), null.alias("cluster"), null.alias("cached_at"))
    return rows.select("doc_id", "url").join(K.as_results(rows.drop("doc_id")), "url").select("doc_id", "url", "domain", "source", "from_cache")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id * 7919 % 1000 DESC, doc_id) AS r FROM documents WHERE source = (SELECT min(source) FROM documents)) WHERE r <= 10")
def domain_pages(spark, d):
    docs = documents(spark, d)
    rows = docs.select("doc_id", C("source").alias("domain"), (C("doc_id") * 7919 % 1000).alias("score"), (-C("doc_id")).alias("cached_at"), C("doc_id").alias("url"))
    first = docs.agg(F.min("source")).first()[0]
    return K.domain_pages(rows, first, 10).select(C("domain").alias("source"), "doc_id")


@query("SELECT doc_id, left('t' || doc_id || ' ' || text, 8000) AS body FROM documents")
def indexed_text(spark, d):
    return documents(spark, d).select("doc_id", K.indexed_text(F.concat(F.lit("t"), "doc_id"), C("text")).alias("body"))


@query("SELECT doc_id, term, tf FROM (SELECT doc_id, lang AS term, 1 AS tf FROM documents WHERE lang <> 'en' UNION ALL SELECT doc_id, source, 2 FROM documents WHERE lang = 'en')")
def index_update(spark, d):
    """Postings after all English documents were written again."""
    docs = documents(spark, d)
    old = docs.select("doc_id", C("lang").alias("term"), F.lit(1).alias("tf"))
    new = docs.filter("lang = 'en'").select("doc_id", C("source").alias("term"), F.lit(2).alias("tf"))
    return S.updated_postings(old, new, "doc_id")


MEANS = "(SELECT user_id::VARCHAR AS domain, count(*) AS page_count, avg(value) AS avg_score FROM events GROUP BY 1)"


def user_domains(spark, d):
    """Users as domains; those with an odd number were explored on that day of January."""
    m = means(spark, d)
    day = F.when(C("user_id") % 2 == 1, F.make_timestamp(F.lit(2024), F.lit(1), (C("user_id") % 31 + 1).cast("int"), F.lit(0), F.lit(0), F.lit(0)))
    return m.select(C("user_id").cast("string").alias("domain"), "page_count", "avg_score", C("last_seen").cast("timestamp").alias("last_seen"), day.alias("last_explored"), F.lit(0).cast("long").alias("explored_pages"), F.lit(0).cast("long").alias("exploration_count"))


@query(f"SELECT domain, round(avg_score, 6) AS avg_score FROM {MEANS} WHERE avg_score >= 0.6 AND (domain::BIGINT % 2 = 0 OR TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (domain::BIGINT % 31) < TIMESTAMP '2024-01-17') ORDER BY avg_score DESC, domain LIMIT 6")
def explorable_domains(spark, d):
    return K.explorable(user_domains(spark, d), F.lit("2024-01-20 00:00:00").cast("timestamp")).select("domain", F.round("avg_score", 6).alias("avg_score"))


@query(f"SELECT coalesce(m.domain, v.domain) AS domain, coalesce(page_count, 0) AS page_count, coalesce(n, 0)::BIGINT AS explored_pages, coalesce(k, 0) AS exploration_count FROM {MEANS} m FULL JOIN (SELECT c_custkey::VARCHAR AS domain, sum(c_custkey % 5) AS n, count(*) AS k FROM customer GROUP BY 1) v ON m.domain = v.domain")
def mark_explored(spark, d):
    """Customers are the domains that were visited."""
    visits = read(spark, d, "customer").select(C("c_custkey").cast("string").alias("domain"), (C("c_custkey") % 5).alias("pages_added"), F.lit(DAY).cast("timestamp").alias("at"))
    return K.mark_explored(user_domains(spark, d), visits).select("domain", "page_count", "explored_pages", "exploration_count")


@query(f"WITH a AS (SELECT event_id, event_id % 100 / 100.0 AS score, ts FROM events WHERE ts >= {AS_OF} - INTERVAL 1 DAY * CASE WHEN event_id % 100 >= 85 THEN 30 WHEN event_id % 100 >= 70 THEN 7 ELSE 3 END) SELECT event_id FROM (SELECT *, row_number() OVER (ORDER BY score, ts, event_id) AS r, count(*) OVER () AS n FROM a) WHERE n <= 100 OR r > 500")
def maintenance(spark, d):
    """Expiry, then the trim, as more than 100 pages are left."""
    e = read(spark, d, "events").select("event_id", C("ts").cast("timestamp").alias("cached_at"), (C("event_id") % 100 / 100.0).alias("score"))
    return K.maintained(e, F.lit(DAY).cast("timestamp"), 100, key="event_id")[0].select("event_id")


VOTES = "(SELECT event_id % 50 AS item, user_id, arg_max(CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END, (ts, event_id)) AS vote FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1, 2)"


def vote_log(spark, d):
    """Purchases are votes for and errors votes against an item, users are queries."""
    e = read(spark, d, "events").filter("event_type in ('purchase', 'error')")
    return e.select(F.concat(F.lit("u"), (C("event_id") % 50).cast("string")).alias("url"), C("user_id").cast("string").alias("query"), F.when(C("event_type") == "purchase", 1).otherwise(-1).alias("feedback"), F.struct("ts", "event_id").alias("ts"))


@query(f"SELECT 'u' || item AS url, sum(vote)::BIGINT AS votes FROM {VOTES} WHERE item % 3 = 0 GROUP BY 1")
def votes_of_urls(spark, d):
    """Votes for a list of URLs."""
    urls = spark.range(50).filter("id % 3 = 0").select(F.concat(F.lit("u"), C("id").cast("string")).alias("url"))
    return K.votes_of(vote_log(spark, d), urls).select("url", "votes")


@query(f"SELECT left(sha256('u' || item), 32) AS url_hash, count(*) AS queries, sum(vote)::BIGINT AS votes FROM {VOTES} GROUP BY 1")
def votes_by_query(spark, d):
    m = K.votes_by_query(vote_log(spark, d))
    return m.select("url_hash", F.size("by_query").cast("long").alias("queries"), F.aggregate(F.map_values("by_query"), F.lit(0).cast("long"), lambda a, x: a + x).alias("votes"))


@query("SELECT lang, count(*) FILTER (doc_id % 11 = 0) AS explored FROM documents GROUP BY 1")
def exploration_count(spark, d):
    return documents(spark, d).groupBy("lang").agg(F.count_if(C("doc_id") % 11 == 0).alias("explored"))


@query(f"SELECT doc_id, round((doc_id * 7919 % 1000) / 1000.0, 3) AS final, CASE WHEN doc_id * 7919 % 1000 / 10.0 >= 64.5 THEN 'high' WHEN doc_id * 7919 % 1000 / 10.0 >= 39.5 THEN 'medium' ELSE 'low' END AS score_band, doc_id * 17 % 100 >= 70 AS is_high_obscurity, doc_id * 31 % 100 >= 50 AS is_high_spam FROM documents")
def result_cards(spark, d):
    part = lambda k, m: F.round((C("doc_id") * k % m) / float(m), 6)
    rows = documents(spark, d).select("doc_id", part(7919, 1000).alias("final"), part(17, 100).alias("obscurity"), part(31, 100).alias("ai_spam"), F.lit(0.0).alias("commercial"), F.lit(False).alias("from_cache"))
    return P.shown(rows).select("doc_id", F.round("final", 3).alias("final"), "score_band", "is_high_obscurity", "is_high_spam")


# budget and crawl


@query(f"SELECT set_id, pos, CASE WHEN r = 1 AND turn <= 2 THEN 1 ELSE 0 END AS granted FROM (SELECT *, row_number() OVER (PARTITION BY set_id, r = 1 ORDER BY pos) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY set_id, domain ORDER BY pos) AS r FROM {REQUESTS}))")
def exploration_grants(spark, d):
    return B.allocate_exploration(page_requests(spark, d), "set_id", 2).select("set_id", "pos", "granted")


@query(f"""WITH a AS (SELECT *, sum(want) OVER (PARTITION BY set_id, domain ORDER BY pos) AS cum FROM {REQUESTS}), b AS (SELECT *, least(limit_, cum) - least(limit_, cum - want) AS c FROM a), e AS (SELECT *, sum(c) OVER (PARTITION BY set_id ORDER BY pos) AS t FROM b)
SELECT set_id, (25 - sum(least(20, t) - least(20, t - c)))::BIGINT AS budget_remaining, (20 - sum(least(20, t) - least(20, t - c)))::BIGINT AS trust_pool_remaining, 5 AS explore_pool_total FROM e GROUP BY 1""")
def budget_summary(spark, d):
    grants = B.allocate(page_requests(spark, d), "set_id", B.pools(25, "informational")[0])
    none = grants.limit(0).select("set_id", "domain", "granted")
    return B.summary(grants, none, "set_id", 25, "informational").select("set_id", "budget_remaining", "trust_pool_remaining", "explore_pool_total")


@query("SELECT set_id, domain FROM (SELECT set_id, domain, used, sum(used) OVER (PARTITION BY set_id) AS spent FROM (SELECT o_custkey AS set_id, o_orderkey % 3 AS domain, sum(o_orderkey % 4 + 1) AS used FROM orders GROUP BY 1, 2)) WHERE spent < 30 AND used < 12")
def feasible_domains(spark, d):
    used = page_requests(spark, d).groupBy("set_id", "domain").agg(F.sum("want").alias("used")).withColumn("limit", F.lit(12))
    return B.feasible(used, "set_id", 30).select("set_id", "domain")


@query("SELECT o_orderkey, round((o_orderkey % 100 / 100.0) * (0.7 + (o_custkey % 100) / 100.0), 6) AS priority FROM orders")
def link_priority(spark, d):
    return read(spark, d, "orders").select("o_orderkey", r6(B.multiplied(C("o_custkey") % 100 / 100.0, C("o_orderkey") % 100 / 100.0), "priority"))


def page_ranks(spark, d):
    rows = page_results(spark, d).select("query_id", "pos", "url", "domain", "outbound_links", F.round(F.pmod(F.xxhash64("pos"), F.lit(1000)) / 1000.0, 3).alias("final"))
    return R.ranked(rows, ("query_id",))


@query(None)
def crawl_deeper(spark, d):
    return X.deeper(page_ranks(spark, d), landed_pages(spark, d), page_trust(spark, d)).drop("content")


@query(None)
def seed_candidates(spark, d):
    return X.seed_candidates(page_ranks(spark, d), page_trust(spark, d)).select("query_id", "link", "domain", "score", "priority", "place")


@query(None)
def expand_seeds(spark, d):
    return X.expand_seeds(page_ranks(spark, d), landed_pages(spark, d), page_trust(spark, d)).drop("content")


@query(None)
def explore_sites(spark, d):
    best = page_trust(spark, d).withColumnRenamed("trust", "avg_score").withColumn("last_explored", F.lit(None).cast("timestamp"))
    best = K.explorable(best, F.lit(DAY).cast("timestamp"))
    return X.explore_domains(page_ranks(spark, d), landed_pages(spark, d), page_trust(spark, d), best).drop("content")
