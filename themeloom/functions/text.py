"""Tokens and n-grams as built-in column expressions."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD2, WORD1 = r"[\p{L}\p{N}_]{2,}", r"[\p{L}\p{N}_]+"


def tokens(text: Column, pattern: str = WORD2, stopwords: Collection[str] = (), longer_than: int = 0) -> Column:
    """Lower-cased words in order; a null text has none."""
    found = F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))
    if stopwords or longer_than:
        words = sorted(stopwords)
        found = F.filter(found, lambda t: (~t.isin(words) if words else F.lit(True)) & (F.length(t) > longer_than))
    return found


def ngrams(words: Column, n: int) -> Column:
    """The runs of n words, joined by spaces. ``words`` should be a column of the table: it is read n times."""
    if n == 1:
        return words
    runs = F.size(words) - (n - 1)
    shifted = [F.slice(words, i, F.greatest(runs, F.lit(0))) for i in range(1, n + 1)]
    out = shifted[0]
    for more in shifted[1:]:
        out = F.zip_with(out, more, lambda x, y: F.concat(x, F.lit(" "), y))
    return out


def grams(words: Column, most: int = 2) -> Column:
    """All n-grams with 1 to ``most`` words."""
    return F.concat(*[ngrams(words, n) for n in range(1, most + 1)])
