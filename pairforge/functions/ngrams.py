"""Tokenisers of the overlap scores and n-gram arrays, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern, -1), lambda t: t != "")


def bleu_tokens(text: Column) -> Column:
    """The mteval-v13a tokens: punctuation apart, but points and commas inside numbers kept."""
    t = F.replace(F.replace(F.replace(text, F.lit("<skipped>"), F.lit("")), F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    for mark, sign in {"&quot;": '"', "&amp;": "&", "&lt;": "<", "&gt;": ">"}.items():
        t = F.replace(t, F.lit(mark), F.lit(sign))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    t = F.regexp_replace(t, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    t = F.regexp_replace(t, r"([^0-9])([\.,])", "$1 $2 ")
    t = F.regexp_replace(t, r"([\.,])([^0-9])", " $1 $2")
    t = F.regexp_replace(t, r"([0-9])(-)", "$1 $2 ")
    return _pieces(t, r"\s+")


def rouge_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return _pieces(F.lower(text), "[^a-z0-9]+")


def rouge_sentences(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), rouge_tokens)


def plain_tokens(text: Column) -> Column:
    return _pieces(text, r"\s+")


def count_words_and_signs(text: Column) -> Column:
    """Words and single signs: a stand-in for a byte-pair vocabulary."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]"))


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams, joined by blanks, in order; none for shorter texts. ``tokens`` should be bound: it is named per n-gram."""
    if n == 1:
        return tokens
    count = F.size(tokens) - n + 1
    spots = F.when(count >= 1, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.concat_ws(" ", *[F.element_at(tokens, i + k) for k in range(n)]))
