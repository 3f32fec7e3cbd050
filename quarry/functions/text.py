"""Column expressions for text: tokens, stop words, stemming, normalisation (OP-P1..P3, OP-R4).

All are built-in Spark expressions (JVM side, codegen where Spark allows).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop-word list of the public Snowball / PostgreSQL
# 'english' dictionary, in its published order.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves "
    "he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being "
    "have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where "
    "why how all any both each few more most other some such no nor not only own same so "
    "than too very s t can will just don should now"
).split()

# Fixed value: words a block may consist of and still carry no content (chunker).
LOW_INFORMATION_FRAGMENTS = ("where", "and", "or", "because", "therefore")

# Fixed value: the characters Python's str.split() / str.strip() treat as whitespace.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
                 "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_WS_CLASS = "[" + "".join(f"\\x{{{ord(c):04x}}}" for c in PY_WHITESPACE) + "]"

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
# Python str.splitlines() boundaries (after \r\n has been folded to \n).
LINE_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
LINE_SPLIT = "[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
UNICODE_SPACE = r"(?U)\s+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c) -> Column:
    """Lower-cased word tokens: maximal runs of letters or digits."""
    return F.filter(F.split(F.lower(col(c)), TOKEN_SPLIT), lambda t: t != "")


def is_stop_word(c) -> Column:
    return col(c).isin(*STOP_WORDS)


def s_stem(c) -> Column:
    """S-stemmer (Harman 1991), first matching rule only; words of 3 letters or fewer stay.

    ies -> y unless preceded by e or a; es -> e unless preceded by a, e or o;
    s -> '' unless preceded by u or s.
    """
    return _s_stem_expr(col(c))


def _s_stem_expr(t: Column) -> Column:
    n = F.length(t)
    return (F.when(n <= 3, t)
            .when(t.endswith("ies") & ~t.endswith("eies") & ~t.endswith("aies"),
                  F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y")))
            .when(t.endswith("es") & ~t.endswith("aes") & ~t.endswith("ees") & ~t.endswith("oes"),
                  F.substring(t, F.lit(1), n - 1))
            .when(t.endswith("s") & ~t.endswith("us") & ~t.endswith("ss"),
                  F.substring(t, F.lit(1), n - 1))
            .otherwise(t))


def strip_unicode(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace (Python's set)."""
    return F.regexp_replace(col(c), f"^{_WS_CLASS}+|{_WS_CLASS}+$", "")


def normalize_question_text(c) -> Column:
    """``" ".join(text.split()).casefold()``: every whitespace character becomes a space
    (``translate``), runs collapse, ends trimmed; casefold approximated by lower + ß -> ss."""
    spaced = F.translate(col(c), PY_WHITESPACE, " " * len(PY_WHITESPACE))
    return F.replace(F.lower(F.trim(F.regexp_replace(spaced, " {2,}", " "))), F.lit("ß"), F.lit("ss"))


def parse_topics(c) -> Column:
    """Comma-separated topics: trimmed, empty dropped, ordered distinct (case-sensitive)."""
    parts = F.transform(F.split(col(c), ","), strip_unicode)
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def topic_label(c) -> Column:
    """Topics joined by '; ' (input: parsed topic array)."""
    return F.array_join(col(c), "; ")


def split_lines(c) -> Column:
    """``str.splitlines()`` as an array: no trailing empty line after a final break."""
    text = F.replace(col(c), F.lit("\r\n"), F.lit("\n"))
    open_end = F.when(F.substring(text, -1, 1).isin(*LINE_BREAKS), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    only_newlines = reduce(lambda a, b: a & b, [~text.contains(x) for x in LINE_BREAKS if x != "\n"])
    return (F.when(F.length(text) == 0, F.array().cast("array<string>"))
            .when(only_newlines, F.split(open_end, "\n")).otherwise(F.split(open_end, LINE_SPLIT)))


def source_paths(c) -> Column:
    """Sorted distinct non-empty paths (input: array<string>)."""
    return F.array_sort(F.array_distinct(F.filter(col(c), lambda x: x.isNotNull() & (x != ""))))
