"""Suffix-array dedup against brute force, and its edge cases."""

import collections
import hashlib
import random

import numpy as np
import pytest

from pairforge.llm import queries, suffixes
from tests.llm.test_llm import SF, docs, none, odd  # noqa: F401


@pytest.mark.parametrize("letters", [1, 2, 4, 200, 5000])
def test_suffix_arrays_and_common_prefixes(letters):
    draw = np.random.default_rng(letters)
    for size in [*range(60), 500, 3000]:
        s = draw.integers(0, letters, size)
        if size > 20 and size % 2:
            s[size // 2 : size // 2 + 10] = s[:10]
        made = suffixes.suffix_array(s, letters).tolist()
        text = s.tolist()
        assert made == sorted(range(size), key=lambda i: text[i:])
        shared = suffixes.permuted_prefixes(s, np.array(made, np.int64))
        for a, b in zip(made, made[1:]):
            n = 0
            while max(a, b) + n < size and text[a + n] == text[b + n]:
                n += 1
            assert shared[b] == n


def brute(rows, least):
    """(n_bytes, removed runs, kept) of each row; a window goes if a smaller key holds it."""
    key_of = lambda k: (k is None, k)
    first = {}
    for key, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - least + 1):
            w = data[i : i + least]
            if w not in first or key_of(key) < key_of(first[w]):
                first[w] = key
    out = []
    for key, text in rows:
        data = (text or "").encode()
        away = bytearray(len(data))
        for i in range(len(data) - least + 1):
            if key_of(first[data[i : i + least]]) < key_of(key):
                away[i : i + least] = b"\1" * least
        spans, i = [], 0
        while i < len(data):
            j = i
            while j < len(data) and away[j] == away[i]:
                j += 1
            if away[i]:
                spans.append((i, j - i))
            i = j
        out.append((key, len(data), tuple(spans), bytes(b for b, a in zip(data, away) if not a)))
    return out


def found(frame, key="doc_id"):
    return [(r[key], r["n_bytes"], tuple(map(tuple, r["removed"])), bytes(r["kept"])) for r in frame.collect()]


def planted(draw, count, letters):
    """Texts with passages of each other, copies, repeats of themselves and common lines."""
    texts = []
    for i in range(count):
        text = "".join(draw.choices(letters, k=draw.randrange(200)))
        for _ in range(draw.randrange(4)):
            if texts:
                other = draw.choice(texts) + text
                a = draw.randrange(len(other) + 1)
                at = draw.randrange(len(text) + 1)
                text = text[:at] + other[a : a + draw.randrange(120)] + text[at:]
        if i % 3 == 0:
            text += "the line that a third of all documents end with, é and more" + str(i)
        texts.append(draw.choice(texts) if texts and i % 7 == 0 else text)
    return texts


@pytest.mark.parametrize("many,least,gram", [(4096, 50, 16), (1, 50, 16), (2, 12, 5), (4096, 12, 5)])
def test_removed_bytes_against_brute_force(spark, monkeypatch, many, least, gram):
    monkeypatch.setattr(suffixes, "MANY_BLOCKS", many)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 2000)
    monkeypatch.setattr(suffixes, "SLICE", 70)
    draw = random.Random(many + least)
    for letters in ("ab", "abcdefghijklmnopqrst ", "\0é漢"):
        texts = planted(draw, 60, letters)
        rows = [(draw.choice([draw.randrange(40), i]), t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, texts[1]), (3, None), (4, "")]
        frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
        got = suffixes.repeats_removed(frame, least=least, gram=gram)
        assert sorted(found(got), key=order) == sorted(brute(rows, least), key=order)


def test_query_against_brute_force(spark, docs):  # noqa: F811
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.suffix_dedup(spark, SF).collect()}
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], 50)
    assert got == {k: (n, sum(m for _, m in s), len(s), hashlib.sha256(kept).hexdigest()) for k, n, s, kept in want}
    assert sum(v[1] for v in got.values()) > 0


def test_edge_cases(spark, odd, none):  # noqa: F811
    got = collections.Counter((r["doc_id"], r["n_bytes"], len(r["kept"])) for r in suffixes.repeats_removed(odd).collect())
    texts = [(r["doc_id"], len((r["text"] or "").encode())) for r in odd.collect()]
    assert sorted((k or 0, n) for k, n, _ in got.elements()) == sorted((k or 0, n) for k, n in texts)
    assert {(k, kept == n) for k, n, kept in got if k in (1, 2, 3, 4, 5, 7, None)} == {(k, True) for k in (1, 2, 3, 4, 5, 7, None)}
    assert [kept for k, n, kept in got if k == 6][0] < 30
    assert suffixes.repeats_removed(none).count() == 0
    with pytest.raises(ValueError):
        suffixes.repeats_removed(odd, least=100, gram=20)


def test_texts_are_shuffled_once(spark, docs):  # noqa: F811
    frame = suffixes.repeats_removed(docs)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") >= 2


def test_query_leaves_texts_of_null_ids_whole(spark, tmp_path):
    """A null doc_id has no smaller one, and is none: such rows lose nothing and take nothing."""
    line = "".join(f"word {i} " for i in range(12))
    rows = [(5, "a " + line), (None, "b " + line), (None, line), (9, "c " + line + " d"), (-4, "other text"), (7, "x" + line[:49])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"]) for r in queries.suffix_dedup(spark, str(tmp_path)).collect())
    n = len(line)
    assert got == [(False, -4, 10, 0, 0), (False, 5, n + 2, 0, 0), (False, 7, 50, 0, 0), (False, 9, n + 4, n + 2 - 1, 1), (True, 0, n, 0, 0), (True, 0, n + 2, 0, 0)]


def test_blocks_without_a_shared_core_are_not_sorted():
    """One anchor in many surroundings: only blocks that hold a window of another holder meet in a suffix array."""
    draw = np.random.default_rng(5)
    for least, gram in [(50, 20), (12, 5), (9, 9)]:
        width, anchor = least - gram, bytes(draw.integers(97, 123, gram, np.uint8))
        pieces, leads = [], []
        for i in range(300):
            left, right = (bytes(draw.integers(97, 123, width, np.uint8)) for _ in range(2))
            if i % 5 == 0 and i:
                near = draw.integers(0, width + 1)
                other, at = pieces[draw.integers(0, i)], leads[0]
                left, right = left[: width - near] + other[at - near : at], other[at + gram : at + gram + width - near] + right[width - near :]
            pieces.append(left + anchor + right)
            leads.append(width)
        holders = draw.integers(0, 200, 300)
        maybe = suffixes._may_share(pieces, np.array(leads), holders, least, gram)
        windows = [{p[k : k + least] for k in range(len(p) - least + 1)} for p in pieces]
        shares = [any(w & windows[j] for j in range(300) if holders[j] != holders[i]) for i, w in enumerate(windows)]
        assert all(m or not s for m, s in zip(maybe, shares))
        assert any(shares) and (least < 50 or maybe.sum() < 200)
