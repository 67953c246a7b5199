"""Vector and string similarity: JVM expressions, and the few Arrow UDFs Spark has no built-in for."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def containment(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


# --- longest common subsequence, bit-parallel -------------------------------------------------

def _masks(tokens) -> dict:
    masks: dict = {}
    for i, token in enumerate(tokens):
        masks[token] = masks.get(token, 0) | (1 << i)
    return masks


def lcs_length(a, b) -> int:
    """Bit-parallel LCS length: one big-integer step per item of ``b``."""
    if not a or not b:
        return 0
    masks, full = _masks(a), (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & masks.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def lcs_positions(ref, can) -> set[int]:
    """Positions in ``ref`` of one longest common subsequence with ``can``.

    The walk back through the table prefers a step to the left when the left cell is larger and a
    step up otherwise. Rows are kept as bit vectors, so memory is len(ref)*len(can)/8 bytes at most.
    """
    if not ref or not can:
        return set()
    masks, full = _masks(can), (1 << len(can)) - 1
    rows, row = [full], full
    for token in ref:
        hit = row & masks.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)

    def table(i: int, j: int) -> int:
        return j - (rows[i] & ((1 << j) - 1)).bit_count()

    i, j, hits = len(ref), len(can), set()
    while i > 0 and j > 0:
        if ref[i - 1] == can[j - 1]:
            hits.add(i - 1)
            i, j = i - 1, j - 1
        elif table(i, j - 1) > table(i - 1, j):
            j -= 1
        else:
            i -= 1
    return hits


def _f_measure(hits: int, ref_size: int, can_size: int) -> float:
    if not hits or not ref_size or not can_size:
        return 0.0
    precision, recall = hits / can_size, hits / ref_size
    return 2 * precision * recall / (precision + recall)


def summary_lcs(ref_sentences: list[list[str]], can_sentences: list[list[str]]) -> float:
    """F-measure of the union over sentences of LCS hits, each token counted at most as often as it occurs."""
    ref_left = Counter(t for s in ref_sentences for t in s)
    can_left = Counter(t for s in can_sentences for t in s)
    ref_size, can_size = ref_left.total(), can_left.total()
    hits = 0
    for ref in ref_sentences:
        found: set[int] = set()
        for can in can_sentences:
            found |= lcs_positions(ref, can)
        for i in sorted(found):
            if ref_left[ref[i]] > 0 and can_left[ref[i]] > 0:
                hits += 1
                ref_left[ref[i]] -= 1
                can_left[ref[i]] -= 1
    return _f_measure(hits, ref_size, can_size)


@F.pandas_udf(_doubles("rougeL", "rougeLsum"))
def rouge_l(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """ROUGE-L and ROUGE-Lsum of (reference, candidate) sentence lists, each an array of token arrays."""
    for refs, cans in batches:
        rows = []
        for ref, can in zip(refs, cans):
            ref_lines = [list(s) for s in ref]
            can_lines = [list(s) for s in can]
            flat_ref = [t for s in ref_lines for t in s]
            flat_can = [t for s in can_lines for t in s]
            hits = lcs_length(flat_ref, flat_can)
            rows.append((_f_measure(hits, len(flat_ref), len(flat_can)), summary_lcs(ref_lines, can_lines)))
        yield pd.DataFrame(rows, columns=["rougeL", "rougeLsum"])


# --- name similarity ----------------------------------------------------------------------------

def damerau_distance(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours (unrestricted form)."""
    limit = len(a) + len(b)
    last_row: dict[str, int] = {}
    rows = [[limit] * (len(b) + 2), [limit, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [limit, i]
        last_match = 0
        for j, y in enumerate(b, 1):
            swap_row = last_row.get(y, 0)
            swapped = rows[swap_row][last_match] + (i - swap_row - 1) + 1 + (j - last_match - 1)
            row.append(min(rows[i][j] + (x != y), row[j] + 1, rows[i][j + 1] + 1, swapped))
            if x == y:
                last_match = j
        rows.append(row)
        last_row[x] = i
    return rows[-1][-1]


def character_bleu(reference: str, text: str) -> float:
    """Sentence BLEU over characters, orders 1 to 4; the k-th zero count becomes ln(length)/(5·2^k)."""
    size = len(text)
    zero_counts, logs = 1, 0.0
    for n in range(1, 5):
        have = Counter(text[i:i + n] for i in range(size - n + 1))
        want = Counter(reference[i:i + n] for i in range(len(reference) - n + 1))
        matched = sum((have & want).values())
        total = max(1, have.total())
        if n == 1 and not matched:
            return 0.0
        value = matched / total
        if not matched and size > 1:
            value = 1 / (2**zero_counts * 5 / math.log(size)) / total
            zero_counts += 1
        if value > 0:
            logs += math.log(value) / 4
    brevity = 1.0 if size > len(reference) else math.exp(1 - len(reference) / size)
    return brevity * math.exp(logs)


@F.pandas_udf(_doubles("name_bleu", "name_edits", "name_lcs"))
def name_distances(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Character BLEU, Damerau distance and LCS distance of two names."""
    for left, right in batches:
        rows = []
        for a, b in zip(left, right):
            longest = max(len(a), len(b))
            lcs = 1.0 - lcs_length(a, b) / longest if longest else 0.0
            rows.append((character_bleu(a, b), float(damerau_distance(a, b)), lcs))
        yield pd.DataFrame(rows, columns=["name_bleu", "name_edits", "name_lcs"])
