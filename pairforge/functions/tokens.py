"""Column helpers on token id arrays: template search, loss masks and padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairforge.functions.binding import bind

IGNORE = -100


def template_starts(tokens: Column, template: Column) -> Column:
    """1-based positions where ``template`` occurs in ``tokens``."""
    n = F.size(template)
    last = F.size(tokens) - n + 1
    spots = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.filter(spots, lambda i: F.slice(tokens, i, n) == template)


def _response_end(tokens: Column, response: Column) -> Column:
    """Number of tokens through the last response template; all of them without one."""
    start = F.array_max(template_starts(tokens, response))
    return F.coalesce(start + F.size(response) - 1, F.size(tokens))


def completion_labels(tokens: Column, response: Column, labels: Column | None = None) -> Column:
    """Labels that keep only what follows the last response template; without one nothing is kept.

    ``labels`` are the labels before masking, the tokens themselves by default. For tokenizers whose
    padding equals the end mark they are :func:`keep_last_token` of the padded labels: restored first,
    masked afterwards, so a row without a template stays masked as a whole.
    """
    return bind(
        _response_end(tokens, response),
        lambda end: F.transform(tokens if labels is None else labels, lambda t, i: F.when(i < end, F.lit(IGNORE)).otherwise(t)),
    )


def keep_last_token(labels: Column, tokens: Column) -> Column:
    """Restore the last label, for tokenizers whose padding equals the end mark."""
    n = F.size(tokens)
    return F.transform(labels, lambda l, i: F.when(i == n - 1, F.get(tokens, i)).otherwise(l))


def multi_turn_labels(tokens: Column, response: Column, human: Column) -> Column:
    """Labels that keep the response spans of a chat.

    Span k of masked tokens runs from human mark k to the end of response mark k; the first
    span starts at token 0, and a human mark without a response masks to the end.
    """
    ends = F.transform(template_starts(tokens, response), lambda i: i - 1 + F.size(response))
    found = F.transform(template_starts(tokens, human), lambda i: i - 1)
    return bind(
        F.struct(ends.alias("ends"), found.alias("found")), lambda at: _span_labels(tokens, at["ends"], at["found"])
    )


def _span_labels(tokens: Column, ends: Column, found: Column) -> Column:
    lead = (F.size(found) > 0) & (F.size(ends) > 0) & (F.get(found, F.lit(0)) > F.get(ends, F.lit(0)))
    starts = F.when(lead, F.concat(F.array(F.lit(0)), found)).otherwise(found)
    spans = F.filter(
        F.arrays_zip(starts.alias("a"), ends.alias("b")),
        lambda s: s["a"].isNotNull() & s["b"].isNotNull(),
    )
    spans = F.transform(
        spans, lambda s, k: F.struct(F.when(k == 0, 0).otherwise(s["a"]).alias("a"), s["b"].alias("b"))
    )
    open_from = F.when(F.size(ends) < F.size(starts), F.element_at(starts, -1))
    nothing = (F.size(found) == 0) | (F.size(ends) == 0)

    def labels(marks: Column) -> Column:
        def label(t: Column, i: Column) -> Column:
            inside = F.exists(marks["spans"], lambda s: (i >= s["a"]) & (i < s["b"]))
            outside = marks["nothing"] | F.coalesce(i >= marks["open_from"], F.lit(False)) | inside
            return F.when(outside, F.lit(IGNORE)).otherwise(t)

        return F.transform(tokens, label)

    return bind(F.struct(spans.alias("spans"), open_from.alias("open_from"), nothing.alias("nothing")), labels)


def prompt_attention(tokens: Column, response: Column) -> Column:
    """Ones through the last response template, zeros after it; all ones without one."""
    return bind(
        _response_end(tokens, response),
        lambda end: F.transform(tokens, lambda t, i: F.when(i < end, F.lit(1)).otherwise(F.lit(0))),
    )


def kept_ids(ids: Column, within: Column) -> Column:
    """Ids that also occur in ``within``; order and repeats stay."""
    return F.filter(ids, lambda x: F.array_contains(within, x))


def pad_right(tokens: Column, length: int | Column, pad: int) -> Column:
    short = F.greatest((F.lit(length) if isinstance(length, int) else length) - F.size(tokens), F.lit(0))
    return F.concat(tokens, F.array_repeat(F.lit(pad), short))


def unmask(labels: Column, pad: int) -> Column:
    return F.transform(labels, lambda x: F.when(x == IGNORE, F.lit(pad)).otherwise(x))
