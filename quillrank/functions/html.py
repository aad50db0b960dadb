"""Fallback page text and titles by regular expressions (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

DROP = T.ascii_edges("(?is)<(script|style|nav|footer|header|aside|noscript)[^>]*>.*?</(script|style|nav|footer|header|aside|noscript)>")
TITLE = T.ascii_edges("(?is)<title[^>]*>(.*?)</title>")


def title(page: Column, url: Column, shortest: int = 3, longest: int = 200) -> Column:
    t = T.trimmed(F.regexp_extract(F.coalesce(page, F.lit("")), TITLE, 1))
    return F.when(F.length(t).between(shortest, longest), t).otherwise(url)


def plain_text(page: Column, most: int = 8000) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.coalesce(page, F.lit("")), DROP, " "), "(?s)<[^>]+>", " ")
    return F.substring(T.trimmed(F.regexp_replace(t, "[ \\t\\n\\r]+", " ")), 1, most)


def hrefs(page: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))
