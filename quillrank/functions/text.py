"""Word, sentence and paragraph expressions (Column -> Column), all JVM-side.

Words are runs without ASCII white space. Where words only have to be counted or picked, one pass of a pattern over the
text does it: lambdas over arrays are interpreted for each word.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE, NO_SPACE = "[ \\t\\n\\r]+", "[^ \\t\\n\\r]"
#: Where a word starts and ends.
START, END = f"(?<!{NO_SPACE})", f"(?!{NO_SPACE})"
SEPARATORS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_ASCII = "[0-9A-Za-z_]"
_EDGE = f"(?:(?<={_ASCII})(?!{_ASCII})|(?<!{_ASCII})(?={_ASCII}))"
_FOLDED = {"s": "\\x{17F}", "k": "\\x{212A}"}  # long s and Kelvin sign


def ascii_edges(pattern: str) -> str:
    """A pattern for Java with the meaning that it has in RE2, by which the SQL counts: \\b stands at ASCII letters, digits
    and _ only (Java takes Ü for a letter, and finds no `best` in `Übest`), \\s has no vertical tab, a line ends at
    \\n only, and (?i) takes two more letters for s and k."""
    flags = "".join(re.findall(r"\(\?([a-z]+)\)", pattern))
    more = _FOLDED if "i" in flags else {}

    def part(before: str, t: str, after: str) -> str:
        letter = lambda x: re.fullmatch(_ASCII, x) and x.lower() not in more
        if t == "\\b":
            if letter(after):
                return f"(?={after})(?<!{_ASCII})"  # looks ahead first, as that fails at most places of a text
            return f"(?!{_ASCII})" if letter(before) else f"(?={part('', after, '')}){_EDGE}" if after in (*more, "\\d") else _EDGE
        if t == "$" and "m" not in flags:
            return "\\z"
        if t[0] == "[":
            t = t.replace("\\s", " \\t\\n\\f\\r")
            return t[:-1] + "".join(v for k, v in more.items() if "a-z" in t.lower() or k in t.lower()) + "]"
        if t in ("\\s", "\\w"):
            return "[ \\t\\n\\f\\r]" if t == "\\s" else "[0-9A-Za-z_" + "".join(more.values()) + "]"
        return f"[{t}{more[t.lower()]}]" if t.lower() in more else t

    parts = ["", *re.findall(r"\[\^?(?:\\.|[^\]\\])+\]|\\[pPx]\{\w+\}|\(\?[a-z]+\)|\\.|.", pattern, re.S), ""]
    return "(?d)" + "".join(map(part, parts, parts[1:], parts[2:]))


def safe(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def stripped(c: Column) -> Column:
    return F.btrim(safe(c), F.lit(" \t\n\r"))


def trimmed(c: Column, also: str = "") -> Column:
    """Without Unicode's space separators, and the characters `also`, at both ends: what trim means in SQL."""
    return F.btrim(c, F.lit(SEPARATORS + also))


def lowered(c: Column) -> Column:
    """In small letters, each letter by itself: lower() would make two characters of İ and look at what follows Σ."""
    return F.lower(F.replace(F.replace(c, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def words(c: Column) -> Column:
    t = stripped(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body refers to it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def word_count(c: Column) -> Column:
    return F.regexp_count(safe(c), F.lit(NO_SPACE + "+"))


def words_like(c: Column, pattern: str) -> Column:
    """The words that match a pattern as a whole."""
    return F.regexp_extract_all(safe(c), F.lit(f"{START}(?:{pattern}){END}"), F.lit(0))


def count_words_like(c: Column, pattern: str) -> Column:
    return F.regexp_count(safe(c), F.lit(f"{START}(?:{pattern}){END}"))


def first_words(c: Column, n: int) -> Column:
    """The first n words, each followed by white space or the end; only so much of the text is read."""
    return words(F.regexp_extract(safe(c), f"^[ \\t\\n\\r]*(?:{NO_SPACE}+(?:{SPACE}|$)){{0,{n}}}", 0))


def trigrams(spaced: Column) -> Column:
    """All three consecutive words of a text whose words stand one space apart."""
    return F.regexp_extract_all(spaced, F.lit("(?<![^ ])(?=([^ ]+ [^ ]+ [^ ]+)(?![^ ]))"), F.lit(1))


def sentences(c: Column, longer_than: int = 8) -> Column:
    return F.filter(F.transform(F.split(safe(c), "[.!?]+"), lambda s: F.btrim(s, F.lit(" \t\n\r"))), lambda s: F.length(s) > longer_than)


def sentence_lengths(c: Column) -> Column:
    """Words of each sentence; sentences have no white space at their ends."""
    return F.transform(sentences(c), lambda s: F.size(F.split(s, SPACE)))


def mean(a: Column) -> Column:
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.when(F.size(a) > 0, total / F.greatest(F.size(a), F.lit(1))).otherwise(0.0)


def variation(a: Column) -> Column:
    """Population standard deviation over the mean (at least 1)."""
    m, n = mean(a), F.greatest(F.size(a), F.lit(1))
    squares = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.sqrt(F.greatest(squares / n - m * m, F.lit(0.0))) / F.greatest(m, F.lit(1.0))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(safe(c), F.lit(pattern))


def is_in(word: Column, vocabulary) -> Column:
    return word.isin(*vocabulary)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1))).otherwise(0.0)
