"""Helpers of the Arrow UDFs against textbook tables."""

import math
import random
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.functions import similarity as sim
from pairforge.operators import retrieve as rt
from pairforge.operators import scoring as sc
from pairforge.operators import tables as tb

WORDS = [[random.Random(s).choice("abcd") for _ in range(random.Random(s + 99).randint(0, 14))] for s in range(60)]


def table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
    return t


def walk(a, b):
    t, i, j, hits = table(a, b), len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            hits.add(i - 1)
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return hits


@pytest.mark.parametrize("k", range(0, 58, 2))
def test_lcs(k):
    a, b = WORDS[k], WORDS[k + 1]
    assert sim.lcs_length(a, b) == table(a, b)[-1][-1]
    assert sim.lcs_positions(a, b) == walk(a, b)


def slow_damerau(a, b):
    @lru_cache(None)
    def d(i, j):
        if not i or not j:
            return i + j
        best = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        for k in range(1, i):
            for l in range(1, j):
                if a[k - 1] == b[j - 1] and a[i - 1] == b[l - 1]:
                    best = min(best, d(k - 1, l - 1) + (i - k - 1) + 1 + (j - l - 1))
        return best

    return d(len(a), len(b))


@pytest.mark.parametrize("k", range(0, 40, 2))
def test_damerau(k):
    a, b = "".join(WORDS[k][:8]), "".join(WORDS[k + 1][:8])
    assert sim.damerau_distance(a, b) == slow_damerau(a, b)


def test_damerau_swap():
    assert sim.damerau_distance("ab", "ba") == 1
    assert sim.damerau_distance("ca", "abc") == 2


def test_character_bleu():
    assert sim.character_bleu("price", "price") == pytest.approx(1.0)
    assert sim.character_bleu("abc", "xyz") == 0.0
    # 3 of 4 letters and 2 of 3 pairs match, 1 of 2 triples, no group of four: smoothed once.
    last = 1 / (2 * 5 / math.log(4)) / 1
    expected = math.exp((math.log(3 / 4) + math.log(2 / 3) + math.log(1 / 2) + math.log(last)) / 4)
    assert sim.character_bleu("abcd", "abcx") == pytest.approx(expected)


def test_rouge_lcs(spark):
    rows = [(1, "the cat sat\non the mat", "the cat\nsat on a mat"), (2, "a b c", ""), (3, "x y", "x y")]
    got = {r["id"]: r for r in sc.rouge_lcs(spark.createDataFrame(rows, "id int, target string, generated string")).collect()}
    assert got[1]["rougeL"] == pytest.approx(2 * (5 / 6) * (5 / 6) / (10 / 6))
    assert got[1]["rougeLsum"] == pytest.approx(5 / 6)
    assert got[2]["rougeL"] == 0.0 and got[3]["rougeLsum"] == 1.0


def test_top_k_is_exact_for_any_blocks(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 5))
    base[7] = base[3] * 2  # a copy in direction: the lower id must win
    asked = np.vstack([rng.normal(size=(6, 5)), base[3]])
    frame = lambda xs, name: spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(xs)], f"{name} bigint, vector array<double>")
    queries, train = frame(asked, "query_id"), frame(base, "base_id")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit(asked) @ unit(base).T, 9)
    want = {q: sorted(range(60), key=lambda b: (-sims[q, b], b))[:4] for q in range(7)}
    for block_bytes in [rt.BLOCK_BYTES, 1, 200]:
        ranked = rt.cosine_top_k(queries, train.repartition(3), 4, block_bytes=block_bytes)
        lists = {r["query_id"]: r["neighbours"] for r in rt.neighbour_lists(ranked).collect()}
        assert lists == want
    assert want[6][:2] == [3, 7]


def test_top_k_leaves_odd_vectors_out(spark):
    base = spark.sql("SELECT * FROM VALUES (1L, array(1d)), (2L, array(0d, 1d)), (3L, array(1d, 1d)), (4L, null), (5L, array(1d, null)) t(base_id, vector)")
    asked = spark.sql("SELECT * FROM VALUES (1L, array(0d, 2d)), (2L, array(1d, 2d, 3d)) t(query_id, vector)")
    got = [(r["query_id"], r["base_id"], r["similarity"]) for r in rt.cosine_top_k(asked, base, 2).orderBy("rank").collect()]
    assert got == [(1, 2, 1.0), (1, 3, pytest.approx(2**-0.5))]
    assert {r["base_id"] for r in rt.odd_vectors(base, 2).collect()} == {1, 4, 5}
    assert rt.cosine_top_k(asked, base.limit(0), 2).count() == 0
    assert rt.cosine_top_k(asked.limit(0), base, 2).count() == 0
    mixed = base.union(spark.sql("SELECT 6L, array(1d, 2d, 3d)")).coalesce(1)
    rows = {(r["query_id"], r["base_id"]) for r in rt.cosine_top_k(asked.coalesce(1), mixed, 2).collect()}
    assert rows == {(1, 2), (1, 3), (2, 6)}  # lengths meet their own kind inside one block


def test_shots_keep_every_query(spark):
    ranked = spark.sql("SELECT * FROM VALUES (1L, 7L, 1), (1L, 8L, 2), (2L, 8L, 1) t(query_id, base_id, rank)")
    train = spark.sql("SELECT 7L AS base_id, 'i' AS instruction, 'q' AS sparql_query")
    got = {r["query_id"]: r["few_shots"] for r in rt.shot_blocks(ranked, train, 2).collect()}
    assert got[1].count("- User: i") == 1 and got[2] == "Examples:\n"


def test_bad_rows_are_reported_not_fatal(spark):
    docs = spark.sql("""SELECT * FROM VALUES (1, '{"a": 1}'), (2, '{"a": '), (3, '5'), (4, null) t(id, json)""")
    assert [(r["id"], r["value"]) for r in tb.flatten_json(docs).collect()] == [(1, "1")]
    assert sorted(r["id"] for r in tb.unreadable_json(docs).collect()) == [2, 3]
    pairs = spark.sql("SELECT 1 AS id, 'a b' AS target, CAST(null AS STRING) AS generated")
    assert sc.rouge_lcs(pairs).first()["rougeL"] == 0.0


def test_cut_keeps_the_lower_ids_among_ties():
    ids, sims = rt._cut(np.arange(20)[::-1][None], np.array([[1.0] * 15 + [0.0] * 5]), 2)
    assert ids.tolist() == [[5, 6]] and sims.tolist() == [[1.0, 1.0]]


def test_cosine_and_containment(spark):
    row = spark.sql("SELECT array(1f, 2f) a, array(3f, 4f) b, 'name' c, 'full name' d").select(
        sim.cosine(F.col("a"), F.col("b")).alias("x"), sim.containment(F.col("c"), F.col("d")).alias("y")
    ).first()
    assert row["x"] == pytest.approx(11 / (math.sqrt(5) * 5)) and row["y"]
