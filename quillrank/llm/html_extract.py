"""Main text of web pages by equivalence classes of template tokens.

A page is a sequence of tokens: opening block tags (with the path of blocks around them) and runs of text. Over the pages
of one host, tokens with the same occurrence vector (how often they stand in each page; compared by sums of hashes of
page and count) form an equivalence class; a token that stands equally often in each page that has it is first told
apart by its ordinal, so that its occurrences are tokens of their own. A class of enough pages and tokens is valid if its
tokens come in one order in all pages and if it nests: it lies in one gap of every other class, or the other way round.
The valid classes make the host's template, a tree of blocks; the text between them fills its slots.

The main text is chosen by statistics of the slots over all pages of the host. From the root of the template the way goes
down into a block as long as that block has at least half of the words outside links that its parent has. In the block
found, these go: texts that stand in half of the host's different pages (a text is counted once for all pages whose
longest text is the same, so copies of a page are no template), slots that are mostly links, and slots with far fewer
different texts than the host's richest slot. Tag and class names are a prior worth PRIOR words for a whole host: they
decide where a host has next to no pages, and mark comments, forms and the like inside the block found.

Nothing of a page is gathered by host but counts: classes come from aggregations, templates are joined back to pages
(broadcast only below BROADCAST_BYTES). Defined results: null and empty html give the empty text; a null url or one
without a host shares the host ''; repeated rows give repeated rows; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MASK, Scratch, table

#: A class needs this share of a host's pages and so many tokens; a repeated text needs this share of the different
#: pages, and so many of them.
SUPPORT, LEAST_TOKENS, LEAST_REPEATS = 0.5, 2, 4
#: Words that the names of a block are worth against the words counted over a host's pages.
PRIOR = 300
#: The way goes down into a block with this share of its parent's words; slots with more links than this go, and slots
#: with fewer different texts than this share of the richest slot's.
DOWN, LINKED, VARIED = 0.5, 0.5, 0.1
BROADCAST_BYTES = 8 << 20
#: Templates that a worker remembers before it forgets them all.
HOSTS = 2000

PART = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*>|[^<]+|<", re.S | re.I)
CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Blocks that hold text of their own and no other part of a layout.
LEAVES = frozenset("title li dt dd caption tr td th p h1 h2 h3 h4 h5 h6 pre address summary hr button figcaption".split())
BOXES = frozenset("html head body nav header footer aside main article section div ul ol dl table thead tbody form fieldset blockquote figure details".split())
BLOCKS = LEAVES | BOXES
HEADINGS = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Blocks that an opening block of the same name ends.
SOFT = frozenset("li dt dd tr td th".split())
ASIDE = frozenset("nav footer aside form button header".split())
ASIDE_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side|menu|nav\w*|breadcrumbs?|header|masthead|footer|comments?|replies|disqus|cookies?|consent|notices?|alert|popup|modal|overlay|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|widget|pagination|skip)(?:$|[\s_-])", re.I)
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:main|article|articlebody|post|entry|story|content)(?:$|[\s_-])", re.I)


@lru_cache(maxsize=50_000)
def hash64(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) >> 1


@lru_cache(maxsize=10_000)
def hint(name: str, attributes: str) -> int:
    """1 if a block's names say main text, -1 if they say that it is set aside, else 0."""
    names = " ".join(x for g in NAMES.findall(attributes) for x in g if x)
    if name in ASIDE or names and name not in ("html", "body", "article", "main") and ASIDE_NAMES.search(names):
        return -1
    return 1 if name in ("article", "main") or names and MAIN_NAMES.search(names) else 0


@lru_cache(maxsize=10_000)
def label(name: str, attributes: str) -> str:
    """A tag as it is told apart: its name, and its classes but for those with digits, which often name one page."""
    classes = sorted({c for g in CLASS.findall(attributes) for x in g for c in x.split() if c.isascii() and not any(map(str.isdigit, c))})
    return f"{name}.{'.'.join(classes)}" if classes else name


class Page:
    """Blocks and texts of a page in order. Of block k: token, ordinal among equal tokens, parent block, tag name and hint.
    Of a text: block, the text, and how many of its characters are links."""

    __slots__ = ("tokens", "ordinals", "parents", "names", "hints", "texts")

    def __init__(self, source: str):
        self.tokens, self.ordinals, self.parents, self.names, self.hints = [0], [0], [-1], [""], [0]
        self.texts: list[list] = []
        paths, seen, at, linked, fresh = [""], {}, 0, 0, True
        names, parents = self.names, self.parents
        for m in PART.finditer(source):
            name = m.group(3)
            if name:
                name = name.lower()
                if name in BLOCKS:
                    if m.group(2):  # closes the nearest block of its name, if there is one
                        k = at
                        while k and names[k] != name:
                            k = parents[k]
                        at, fresh = parents[k] if k else at, True
                        continue
                    if name not in ("button", "hr"):
                        while names[at] in HEADINGS or name in SOFT and names[at] == name:
                            at = parents[at]
                    attributes = m.group(4) or ""
                    path = f"{paths[at]}/{label(name, attributes) if attributes else name}"
                    token = hash64(path)
                    seen[token] = seen.get(token, 0) + 1
                    self.tokens.append(token)
                    self.ordinals.append(seen[token])
                    parents.append(at)
                    names.append(name)
                    self.hints.append(hint(name, attributes))
                    paths.append(path)
                    if name != "hr":
                        at = len(names) - 1
                    fresh = True
                elif name == "br":
                    fresh = True
                elif name == "a":
                    linked = 0 if m.group(2) else 1
            else:
                raw = m.group(0)
                if raw[0] != "<" or raw == "<":
                    if fresh:
                        self.texts.append([at, raw, linked * len(raw)])
                        fresh = False
                    else:  # around inline tags and comments
                        self.texts[-1][1] += raw
                        self.texts[-1][2] += linked * len(raw)
        done = []
        for block, raw, links in self.texts:
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                done.append([block, text, links / max(1, len(raw))])
        self.texts = done

    def inside(self, name: str) -> list[bool]:
        """Of each block, whether it is or lies in a block of this tag name."""
        out = []
        for p, n in zip(self.parents, self.names, strict=True):
            out.append(n == name or p >= 0 and out[p])
        return out

    def run(self, k: int) -> int:
        """The token of a text."""
        block, text, _ = self.texts[k]
        return xxhash.xxh3_64_intdigest(f"{self.tokens[block]} {text}") >> 1

    def signature(self) -> int:
        """Of its longest text, which copies of the page share."""
        return xxhash.xxh3_64_intdigest(max((t for _, t, _ in self.texts), key=len, default="")) >> 1


def host_of(column: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(column), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


VECTORS = "host string, token long, of_text boolean, signature long, pages long, least long, most long, s1 long, s2 long, v1 long, v2 long"


def vectors(batches):
    """Partial occurrence vectors: for each host and token of a batch, pages, least and most occurrences, sums of hashes
    of pages, and of pages with counts. A text's rows are split by the signature of its pages; token 0 is the page."""
    for b in batches:
        stats: dict[tuple, list[int]] = {}
        for page, host, source in zip(b.column("page").to_pylist(), b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            p, count, texts = Page(source), {}, {}
            for t in p.tokens[1:]:
                count[t] = count.get(t, 0) + 1
            for k in range(len(p.texts)):
                t = p.run(k)
                texts[t] = texts.get(t, 0) + 1
            texts[0] = 1
            signature = p.signature()
            h = page & MASK
            one, two = h * 0x9E3779B97F4A7C15 & MASK, (h ^ 0x5851F42D4C957F2D) * 0xBF58476D1CE4E5B9 & MASK
            for found, key in ((count, 0), (texts, signature)):
                for t, n in found.items():
                    s = stats.get((host, t, key))
                    if s is None:
                        s = stats[host, t, key] = [found is texts, 0, n, n, 0, 0, 0, 0]
                    s[1] += 1
                    s[2], s[3] = min(s[2], n), max(s[3], n)
                    s[4] += one
                    s[5] += two
                    s[6] += (one ^ n) * 0x94D049BB133111EB & MASK
                    s[7] += (two ^ n) * 0x9E3779B97F4A7C15 & MASK
        keys = list(stats)
        long = lambda k: pa.array([stats[x][k] for x in keys], pa.int64())
        cut = lambda k: pa.array(np.array([stats[x][k] & MASK for x in keys], np.uint64).view(np.int64))
        cols = [pa.array([x[0] for x in keys], pa.string()), pa.array([x[1] for x in keys], pa.int64()), pa.array([stats[x][0] for x in keys], pa.bool_()), pa.array([x[2] for x in keys], pa.int64()), long(1), long(2), long(3), cut(4), cut(5), cut(6), cut(7)]
        yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in VECTORS.split(", ")])


def nests(inner: list[int], outer: list[int]) -> bool:
    """inner lies inside one gap of outer, or before or after it."""
    return np.searchsorted(outer, inner[0]) == np.searchsorted(outer, inner[-1])


def runs_of(page: Page, classes: dict[int, int]) -> dict[int, list[int]]:
    """For each class, the blocks of its tokens in order."""
    out: dict[int, list[int]] = {}
    for k, t in enumerate(page.tokens):
        c = classes.get(t)
        if c is not None:
            out.setdefault(c, []).append(k)
    return out


def key_of(page: Page, k: int) -> int:
    """Names a block of constant count in all pages of its host: its token and ordinal."""
    return ((page.tokens[k] + page.ordinals[k] * 0xBF58476D1CE4E5B9) * 0x9E3779B97F4A7C15 & MASK) >> 1


def boxes_of(page: Page, constant: set[int]) -> list[int]:
    """For each block, the nearest box around it (itself included) that the template can name; 0 is the page."""
    out = [0]
    for k in range(1, len(page.tokens)):
        out.append(k if page.tokens[k] in constant and page.names[k] in BOXES else out[page.parents[k]])
    return out


SLOTS = "host string, class long, lo long, hi long, nested long, key long, parent long, hint long, words long, links long, text long, pages long"


def slots(batches):
    """Two kinds of rows. Of each class of a batch: the least and largest hash of its order in a page, and whether it nests
    in all. Of each box of a template and each text of its slot: parent, hint, words and linked words of the slot."""
    known: dict[str, tuple] = {}
    for b in batches:
        orders: dict[tuple, list[int]] = {}
        stats: dict[tuple, list[int]] = {}
        candidates = b.column("tokens")
        for i, (host, source) in enumerate(zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True)):
            if host not in known:
                if len(known) >= HOSTS:
                    known.clear()
                found = candidates[i].as_py() or ()
                known[host] = {x["token"]: x["class"] for x in found}, {x["class"]: x["presence"] for x in found}, {x["token"] for x in found if x["constant"]}
            classes, presence, constant = known[host]
            page = Page(source)
            runs = runs_of(page, classes)
            for c, run in runs.items():
                order = xxhash.xxh3_64_intdigest(np.array([page.tokens[k] for k in run], np.int64).tobytes()) >> 1
                fine = all(nests(run, o) or nests(o, run) for k, o in runs.items() if presence[k] != presence[c])
                v = orders.setdefault((host, c), [order, order, 1])
                v[0], v[1], v[2] = min(v[0], order), max(v[1], order), v[2] & fine
            box, filled = boxes_of(page, constant), {}
            for block, text, linked in page.texts:
                filled.setdefault(box[block], []).append((text, linked))
            for k in {x for x in box if x}:
                parts = filled.get(k, ())
                words, links = 0, 0
                for text, linked in parts:
                    n = text.count(" ") + 1
                    links += round(n * linked)
                    words += n - round(n * linked)
                text = xxhash.xxh3_64_intdigest(" ".join(t for t, _ in parts)) >> 1 if parts else None
                up = box[page.parents[k]]
                s = stats.setdefault((host, classes[page.tokens[k]], key_of(page, k), key_of(page, up) if up else 0, page.hints[k], text), [0, 0, 0])
                for j, x in enumerate((words, links, 1)):
                    s[j] += x
        a, z = list(orders), list(stats)
        none = lambda x: [None] * len(x)
        cols = [
            [k[0] for k in a] + [k[0] for k in z], [k[1] for k in a] + [k[1] for k in z],
            *([orders[k][j] for k in a] + none(z) for j in range(3)),
            *(none(a) + [k[j] for k in z] for j in (2, 3, 4)),
            *(none(a) + [stats[k][j] for k in z] for j in (0, 1)),
            none(a) + [k[5] for k in z], none(a) + [stats[k][2] for k in z],
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if j else pa.string()) for j, c in enumerate(cols)], [x.split()[0] for x in SLOTS.split(", ")])


class Template:
    """A host's template: the tree of its boxes with what their slots hold over all pages, and its repeated texts."""

    def __init__(self, boxes=(), repeated=()):
        self.repeated = frozenset(repeated)
        self.parent = {b["key"]: b["parent"] for b in boxes}
        self.own = {b["key"]: b["words"] for b in boxes}
        self.hint = {b["key"]: b["hint"] for b in boxes}
        most = max((b["varied"] for b in boxes), default=0)
        linked = {b["key"] for b in boxes if b["links"] > LINKED * (b["links"] + b["words"])}
        self.chrome = linked | {b["key"] for b in boxes if b["words"] and b["varied"] < VARIED * most}
        self.words = dict(self.own)
        for k in self.own:  # words of a box with all boxes in it
            up, steps = self.parent.get(k), 0
            while up in self.words and steps < 1000:
                self.words[up] += self.own[k]
                up, steps = self.parent.get(up), steps + 1

    def main(self, keys: dict[int, int], children: dict[int, list[int]]) -> int:
        """The block of a page that holds its main text, by the words of the whole host. keys: of blocks in the template."""
        weight = lambda k: max(0, self.words.get(keys[k], 0) + PRIOR * self.hint.get(keys[k], 0))
        at = 0
        while at in children:
            best = max(children[at], key=lambda k: (weight(k), -k))
            if not weight(best) or weight(best) < DOWN * (sum(map(weight, children[at])) + (self.own.get(keys[at], 0) if at else 0)):
                break
            at = best
        return at

    def text(self, source: str | None) -> str:
        if not source:
            return ""
        page = Page(source)
        keys = {0: 0}
        box, children = [0], {}
        for k in range(1, len(page.tokens)):
            key = key_of(page, k) if page.names[k] in BOXES else None
            if key in self.own:
                keys[k] = key
                children.setdefault(box[page.parents[k]], []).append(k)
                box.append(k)
            else:
                box.append(box[page.parents[k]])
        main, out = self.main(keys, children), []
        head = page.inside("head")
        titled = page.inside("title")
        kept = [False] * len(page.tokens)  # in the main block, and not set aside there
        article = page.inside("article")
        for k in range(len(page.tokens)):
            if k == main:
                kept[k] = True
            elif k and kept[page.parents[k]]:
                marked = page.hints[k] < 0 and not (page.names[k] == "header" and article[k])
                kept[k] = not marked and not (k in keys and keys[k] in self.chrome)
        for i, (block, text, _) in enumerate(page.texts):
            if kept[block] and not head[block] and not titled[block] and page.run(i) not in self.repeated:
                out.append(text)
        return " ".join(out)


def extract(batches):
    known: dict[str, Template] = {}
    for b in batches:
        out, boxes, repeated = [], b.column("boxes"), b.column("repeated")
        for i, (source, host) in enumerate(zip(b.column("html").to_pylist(), b.column("host").to_pylist(), strict=True)):
            if host not in known:
                if len(known) >= HOSTS:
                    known.clear()
                known[host] = Template(boxes[i].as_py() or (), repeated[i].as_py() or ())
            out.append(known[host].text(source))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def joined(pages: DataFrame, templates: DataFrame, size: int) -> DataFrame:
    return pages.join(F.broadcast(templates) if size <= BROADCAST_BYTES else templates, "host", "left")


def templates_of(some: DataFrame, scratch: Scratch, support: float = SUPPORT) -> tuple[DataFrame, int]:
    """(host, boxes, repeated) of pages (page, host, html), and about how many bytes that is."""
    wrap = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)  # noqa: E731  sums of hashes, exact
    sums = ("s1", "s2", "v1", "v2")
    stats = some.mapInArrow(vectors, VECTORS).groupBy("host", "token").agg(F.first("of_text").alias("of_text"), F.sum("pages").alias("pages"), F.min("least").alias("least"), F.max("most").alias("most"), F.approx_count_distinct("signature").alias("different"), *map(wrap, sums))
    stats = scratch.keep(stats.filter(F.col("pages") >= F.when(F.col("of_text") & (F.col("token") != 0), LEAST_REPEATS).otherwise(1)), "stats")
    hosts = stats.filter("token = 0").select("host", F.col("pages").alias("of"), F.col("different").alias("hosts_different"))
    repeated = stats.filter("of_text and token <> 0").join(hosts, "host").filter((F.col("different") >= LEAST_REPEATS) & (F.col("different") >= support * F.col("hosts_different")))
    repeated = repeated.groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("repeated"))

    # Partial sums differ by multiples of 2^64 with how pages were dealt, so they are compared modulo 2^64. A token of
    # constant count is as many tokens by ordinal, whose vector says in which pages they are; those that stand equally
    # often are held against each other for their order.
    modulo = [F.pmod(c, F.lit(str(1 << 64)).cast("decimal(20,0)")).alias(c) for c in sums]
    constant = (F.col("least") == F.col("most")).alias("constant")
    often = stats.filter("not of_text").join(hosts, "host").filter(F.col("pages") >= support * F.col("of")).select("host", "token", "pages", "most", constant, *modulo)
    vector = F.when(F.col("constant"), F.xxhash64("pages", "s1", "s2")).otherwise(F.xxhash64("pages", "v1", "v2", F.lit("count")))
    often = often.withColumn("presence", vector).withColumn("class", F.xxhash64("presence", F.when(F.col("constant"), F.col("most")))).select("host", "token", "constant", "most", "presence", "class")
    enough = often.groupBy("host", "presence").agg(F.sum(F.when(F.col("constant"), F.col("most")).otherwise(1)).alias("n")).filter(F.col("n") >= LEAST_TOKENS)
    often = scratch.keep(often.join(enough.select("host", "presence"), ["host", "presence"], "left_semi"), "classes")
    size = often.agg(F.count("*")).first()[0] * 64
    of_host = often.groupBy("host").agg(F.collect_list(F.struct("token", "class", "presence", "constant")).alias("tokens"))
    said = joined(some.select("host", "html"), of_host, size).mapInArrow(slots, SLOTS).groupBy("host", "class", "key", "parent", "hint")
    said = scratch.keep(said.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("nested").alias("nested"), F.sum("words").alias("words"), F.sum("links").alias("links"), F.approx_count_distinct("text").alias("varied"), F.sum("pages").alias("pages")), "slots")
    valid = said.filter("key is null and lo = hi and nested = 1").select("host", "class")
    found = said.filter("key is not null").join(valid, ["host", "class"], "left_semi")
    boxes = found.groupBy("host", "key").agg(F.max_by("parent", "pages").alias("parent"), F.max_by("hint", "pages").alias("hint"), F.sum("words").alias("words"), F.sum("links").alias("links"), F.max("varied").alias("varied"))
    boxes = boxes.groupBy("host").agg(F.collect_list(F.struct("key", "parent", "hint", "words", "links", "varied")).alias("boxes"))
    return scratch.keep(boxes.join(repeated, "host", "full_outer"), "templates"), size


def extract_pages(spark: SparkSession, pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    scratch = Scratch(spark, "html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of("url"))
    some = rows.filter(F.length("html") > 0).select(F.xxhash64("page_id", "url").alias("page"), "host", "html")
    templates, size = templates_of(some, scratch, support)
    return joined(rows, templates, size).select("page_id", "url", "html", "host", "boxes", "repeated").mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark, table(spark, sf_dir, "pages"))


#: What the test pages hold, by a plainer way that knows their one layout: the article element, its blocks in order.
SQL = {
    "op1_html_extract": """
SELECT page_id, url, t AS text, length(t) AS n_chars FROM (
  SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(
    coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), ''), '(?s)<!--.*?-->', '', 'g'), '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g'),
    '&quot;', '"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \\t\\n\\r]+', ' ', 'g')) AS t FROM pages)
"""
}
