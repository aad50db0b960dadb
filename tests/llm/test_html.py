"""Template deduction on pages without telling names, and its classes against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillrank.llm import html_extract as H
from quillrank.llm.common import Scratch


def some(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def bare():
    """Pages of one host, all of plain divs: menu, notice, article with a repeated line and a list of links, footer."""
    rng, rows, want = random.Random(31), [], {}
    for i in range(14):
        head, parts = some(rng, 5), [some(rng, rng.randrange(8, 60)) for _ in range(rng.randrange(1, 6))]
        menu = "".join(f"<li><a href='/{k}'>{some(rng, 1)}</a></li>" for k in range(5))
        links = "".join(f"<li><a href='/x{k}'>{some(rng, 3)}</a></li>" for k in range(3))
        body = f"<h1>{head}</h1>" + "".join(f"<p>{p}</p>" for p in parts) + f"<p>Join our list today</p><div><ul>{links}</ul></div>"
        rows.append((i, f"https://bare.example/{i}", f"<html><head><title>{head}</title></head><body><div><ul>{menu}</ul></div><div>{some(rng, 9)}</div><div>{body}</div><div>{some(rng, 6)}</div></body></html>"))
        want[i] = " ".join([head, *parts])
    return rows, want


def test_the_template_makes_the_text(spark, bare):
    rows, want = bare
    got = {r["page_id"]: r["text"] for r in H.extract_pages(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    assert all(H.Template().text(source) != want[i] for i, _, source in rows)


def test_copies_of_a_page_are_no_template(spark, bare):
    rows, want = bare
    copies = rows + [(100 + k, f"https://bare.example/c{k}", rows[0][2]) for k in range(40)]
    got = {r["page_id"]: r["text"] for r in H.extract_pages(spark, spark.createDataFrame(copies, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in want} == want and {got[100 + k] for k in range(40)} == {want[0]}


def test_classes_against_brute_force(spark, bare):
    rows, _ = bare
    odd = (50, "https://bare.example/odd", "<html><body><table><tr><td>other</td></tr></table></body></html>")
    pages = spark.createDataFrame([*rows, odd], "page_id long, url string, html string").withColumn("host", H.host_of("url"))
    scratch = Scratch(spark, "test")
    H.templates_of(pages.select(F.xxhash64("page_id", "url").alias("page"), "host", "html"), scratch)
    got = defaultdict(set)
    for r in spark.read.parquet(scratch.path("classes")).collect():
        got[r["presence"]].add(r["token"])

    vectors = defaultdict(dict)
    for i, _, source in [*rows, odd]:
        for t in H.Page(source).tokens[1:]:
            vectors[t][i] = vectors[t].get(i, 0) + 1
    want, size = defaultdict(set), defaultdict(int)
    for t, v in vectors.items():
        if 2 * len(v) >= len(rows) + 1:
            constant = len(set(v.values())) == 1
            key = (frozenset(v), None) if constant else (frozenset(v.items()), "count")
            want[key].add(t)
            size[key] += max(v.values()) if constant else 1
    assert sorted(map(sorted, got.values())) == sorted(sorted(ts) for k, ts in want.items() if size[k] >= H.LEAST_TOKENS)


def test_order_and_nesting():
    assert H.nests([3, 4], [1, 2, 9]) and H.nests([5], [1, 9]) and not H.nests([3, 12], [1, 9])
    shown = H.Page("<div><p>a <a href='x'>b</a><p>c</div>")
    assert [(shown.names[b], t, round(share, 1)) for b, t, share in shown.texts] == [("p", "a b", 0.3), ("p", "c", 0.0)]


def test_without_a_template():
    page = "<html><body><nav>menu</nav><div class='ad'>buy</div><article><h1>T &amp; x</h1><p>a <b>b</b>c<br>d</p><div class='comments'>no</div></article><footer>f</footer><script>var a='<p>';</script>"
    assert H.Template().text(page) == "T & x a bc d"
    assert H.Template().text(None) == H.Template().text("") == ""
