"""Periodic runs of words, found by an online, sparse DP over diagonals.

A run is a stretch of words with smallest period ``q`` and at least ``max(least, times * q)`` words
that neither neighbour extends. On the diagonal of lag ``q`` (word ``i`` against word ``i - q``) it is
an unbroken match of ``(times - 1) * q`` words or more. For each word its earlier occurrences would
increment the match lengths of all their lags, which is quadratic in a word's frequency. Only lags
that can still become a run are kept, and exactly one per word: lags are dealt into levels ``lo..hi``,
and at a level two words count as the same only together with the ``g`` words from there on, with
``2 * hi <= g <= (times - 1) * lo``. A context of ``g`` words inside a run of period ``q`` has the
smallest period ``q`` itself (two periods that sum up to ``g`` at most would have a common divisor as
period), so its nearest earlier occurrence is at lag ``q``; any other lag of that word is no run. Each
word thus continues the diagonal of its nearest occurrence, and where the lag changes the diagonal
ends and its run is emitted. Contexts are named exactly by doubling, only where they repeat in the
document, so a text of n words costs n log n whatever it repeats, and mostly one look.

Documents are independent rows: nothing is shuffled. Null texts count as empty and have no words;
very long texts are one slice of their own; repeated rows and keys and null keys are treated row by
row; runs of equal start are ordered by period; an empty table gives no rows; only ``key`` and
``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import arrow_map, keyed, slices, texts_of

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _levels(least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(context, smallest lag, largest lag): every lag once; a context is as long as the shortest match allows."""
    low = 1
    while True:
        context = (times - 1) * low
        while all(context + 1 <= max(least, times * q) - q for q in range(low, (context + 1) // 2 + 1)):
            context += 1
        yield context, low, context // 2
        low = context // 2 + 1


def _named(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """Numbers of pairs that occur more than once, -1 elsewhere (and where one half already is -1)."""
    names = np.full(size, -1, np.int64)
    at = np.flatnonzero((left[: len(right)] >= 0) & (right >= 0))
    if len(at):
        pairs = left[at] << 32 | right[at]
        _, number, count = np.unique(pairs, return_inverse=True, return_counts=True)
        names[at] = np.where(count[number] > 1, number, -1)
    return names


def _diagonals(words: np.ndarray, least: int, times: int) -> np.ndarray:
    """(start, length, period) of all runs of a sequence of word numbers."""
    n, found = len(words), [np.empty((0, 3), np.int64)]
    power, names = 1, words.astype(np.int64)
    for context, low, high in _levels(least, times):
        while 2 * power <= context:
            names = _named(names, names[power:], n)
            power *= 2
        if not (names >= 0).any():
            break
        grams = names if context == power else _named(names, names[context - power :], n)
        at = np.flatnonzero(grams >= 0)
        if not len(at):
            continue
        order = at[np.argsort(grams[at], kind="stable")]
        lag = np.zeros(n, np.int64)
        same = grams[order[1:]] == grams[order[:-1]]
        lag[order[1:][same]] = (order[1:] - order[:-1])[same]
        at = np.flatnonzero((lag >= low) & (lag <= high))
        if not len(at):
            continue
        breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(lag[at]) != 0))
        first, last = at[np.concatenate([[0], breaks + 1])], at[np.concatenate([breaks, [len(at) - 1]])]
        period = lag[first]
        length = last - first + context + period
        keep = length >= np.maximum(least, times * period)
        found.append(np.stack([first - period, length, period], axis=1)[keep])
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _numbered(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers that differ from document to document, so nothing matches across; where each begins."""
    numbers, begins, most = [], [0], 0
    for words in lists:
        known: dict[bytes, int] = {}
        numbers.extend([known.setdefault(w, most + len(known)) for w in words])
        most += len(known)
        begins.append(len(numbers))
    return np.array(numbers, np.int64), np.array(begins, np.int64)


def _collapse(lists: list[list[bytes]], least: int, times: int) -> tuple[list, list, np.ndarray, np.ndarray]:
    numbers, begins = _numbered(lists)
    runs = _diagonals(numbers, least, times)
    # A word goes if any run holds it after the run's first period.
    depth = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    stays = np.cumsum(depth[:-1]) == 0
    ends = np.searchsorted(runs[:, 0], begins)
    kept = [
        b" ".join(words if ends[i] == ends[i + 1] else compress(words, stays[begins[i] : begins[i + 1]].tolist()))
        for i, words in enumerate(lists)
    ]
    runs[:, 0] -= np.repeat(begins[:-1], np.diff(ends))
    return kept, [len(words) for words in lists], runs, ends


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """(key, n_words, runs, collapsed) of each row: its runs by start, then period, and the words that stay.

    ``times`` is 3 at least; a run has ``max(least, times * period)`` words at least.
    """
    if times < 3:
        raise ValueError("runs need three periods at least")
    own = keyed(docs, key, text)

    def work(batch):
        texts = texts_of(batch)
        for begin, end in slices(texts):
            kept, counts, runs, ends = _collapse([t.split() for t in texts[begin:end]], least, times)
            spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in runs.T], ["start", "length", "period"])
            yield {
                "id": batch.column("id")[begin:end],
                "n_words": pa.array(counts, pa.int64()),
                "runs": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), spans),
                "collapsed": pa.array(kept, pa.binary()).cast(pa.string()),
            }

    made = arrow_map(own, work, f"id {dict(own.dtypes)['id']}, n_words bigint, runs {RUNS}, collapsed string")
    return made.withColumnRenamed("id", key)


def strongest(runs):
    """The run of greatest exact length by period; among equals the first, then the shorter period."""

    def before(x, y):
        here, there = x["length"] * y["period"], y["length"] * x["period"]
        tie = F.when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"]))
        return F.when(here > there, -1).when(here < there, 1).otherwise(tie.cast("int"))

    return F.get(F.array_sort(runs, before), F.lit(0))
