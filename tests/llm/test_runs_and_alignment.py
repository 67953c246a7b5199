"""Periodic runs and tokenizer alignment against brute force, and their edge cases."""

import collections
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pairforge.llm import alignment, queries, runs
from tests.llm.test_llm import LONG, SF, docs, none, odd  # noqa: F401

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_runs(words, least=6, times=4):
    """Every maximal stretch of every period, kept where no smaller one fits."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and (i, j + q) not in found:
                found[i, j + q] = q
            i = j + 1
    return sorted((i, j - i, q) for (i, j), q in found.items())


@pytest.mark.parametrize("least,times", [(6, 4), (1, 3), (30, 5)])
def test_runs_of_random_words(least, times):
    draw = random.Random(least)
    for size in range(400):
        words = draw.choices("ab" if size % 3 else "abc", k=draw.randrange(size % 80 + 1))
        for _ in range(draw.randrange(3)):
            at, block = draw.randrange(len(words) + 1), draw.choices("abcd", k=draw.randrange(1, 9))
            words[at:at] = (block * 9)[: draw.randrange(1, 9 * len(block))]
        other = draw.choices("ab", k=7)
        kept, counts, made, ends = runs._collapse([[w.encode() for w in x] for x in (words, other)], least, times)
        want = brute_runs(words, least, times)
        assert [tuple(r) for r in made[: ends[1]].tolist()] == want and counts == [len(words), 7]
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert kept[0].decode() == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_one_word_many_times_is_one_look(spark):
    rows = spark.createDataFrame([(1, "a " * 300_000), (2, "a b " * 100_000)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["runs"], r["collapsed"]) for r in runs.periodic_runs(rows).collect()}
    assert [tuple(r) for r in got[1][0]] == [(0, 300_000, 1)] and got[1][1] == "a"
    assert [tuple(r) for r in got[2][0]] == [(0, 200_000, 2)] and got[2][1] == "a b"


def test_runs_query_against_brute_force(spark, docs):  # noqa: F811
    got = {r["doc_id"]: r for r in queries.periodic_runs(spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for key, text in rows:
        words, h = (text or "").encode().split(), zlib.crc32(str(key).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        found = [tuple(r) for r in runs._diagonals(runs._numbered([words])[0], 6, 4).tolist()]
        if n < 1500:
            assert found == brute_runs(words)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        row = got[key]
        assert (row["start"], row["length"], row["period"]) == (best or (None,) * 3) and row["n_runs"] == len(found)
        assert row["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        assert row["collapsed_sha256"] == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()


def test_runs_edge_cases(spark, odd, none):  # noqa: F811
    got = runs.periodic_runs(odd)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    found = sorted([(r["doc_id"] or 0, r["n_words"], len(r["runs"]), len(r["collapsed"])) for r in got.collect()])
    assert [f[:3] for f in found] == [(0, 7, 0), (1, 7, 0), (2, 0, 0), (3, 0, 0), (4, 30000, 1), (4, 30000, 1), (5, 0, 0), (6, 30001, 1), (7, 5, 0)]
    assert runs.periodic_runs(none).count() == 0 and queries.with_periods(odd).count() == 9
    with pytest.raises(ValueError):
        runs.periodic_runs(odd, times=2)


def brute_alignment(texts):
    """(n_a, n_b, groups, links) of each text by walking over both token lists."""
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    signs, out = alignment._byte_signs(), []
    for text in texts:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        x = [bytes(signs[c] for c in first.id_to_token(i)) for i in a]
        y = [alignment.Tokenizers._piece(second.id_to_piece(i)) for i in b]
        if not text or b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            out.append((0, 0, [], []))
            continue
        spans = [[(sum(map(len, e[:i])), sum(map(len, e[: i + 1]))) for i in range(len(e))] if len(e) < 400 else list(zip(np.cumsum([0] + [len(p) for p in e])[:-1].tolist(), np.cumsum([len(p) for p in e]).tolist())) for e in (x, y)]
        groups, i, j = [], 0, 0
        while i < len(a):
            p, q = i + 1, j + 1
            while spans[0][p - 1][1] != spans[1][q - 1][1]:
                if spans[0][p - 1][1] < spans[1][q - 1][1]:
                    p += 1
                else:
                    q += 1
            groups.append((range(i, p), range(j, q)))
            i, j = p, q
        links = [
            (a[i], b[j])
            for g, h in groups
            for i in g
            for j in h
            if max(spans[0][i][0], spans[1][j][0]) < min(spans[0][i][1], spans[1][j][1])
        ]
        lines = [",".join(str(a[i]) for i in g) + "|" + ",".join(str(b[j]) for j in h) for g, h in groups]
        out.append((len(a), len(b), lines, links))
    return out


def brute_rows(texts):
    made = brute_alignment(texts)
    count = collections.Counter(p for m in made for p in set(m[3]))
    best = collections.defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [
        (na, nb, len(g), len(li), sum(count[p] == best[p[0]] for p in li), sum(count[p] for p in li), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for na, nb, g, li in made
    ]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [None, "", " ", "a", "two  spaces", " leading", "trailing ", "line\nbreak", "<|endoftext|> and <s> </s> <unk>", "<0x41>", "漢字 😀 é é ﬁ", "\t", "tokenizer tokenizer", "x" * 3000]


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 50])
def test_alignment_against_brute_force(spark, docs, monkeypatch, frequent):  # noqa: F811
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 20_000)
    monkeypatch.setattr(alignment, "HELD", 1000)
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()] + ODD + ODD[:5]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.scored(rows, alignment.Models.read(A, B)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_rows(texts)


def test_alignment_edge_cases(spark, odd, none):  # noqa: F811
    models = alignment.Models.read(A, B)
    got = alignment.scored(odd, models).collect()
    assert len(got) == 9 and {r["n_a"] for r in got if r["doc_id"] in (2, 3)} == {0}
    assert all(r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] for r in got)
    assert alignment.scored(none, models).count() == 0
    assert len(LONG) > 100_000


def test_remembered_pre_tokens_give_the_ids_of_the_tokenizer():
    tokenizers = alignment.Tokenizers(alignment.Models.read(A, B))
    draw = random.Random(5)
    signs = [" ", "  ", "\n", "\t", "\r", "'ll", "'s", "'", "a", "É", "ß", "x1", "22", "½", "²", "ª", "…", "—", "«", "漢", "あ", "ж", "Ω", "<|endoftext|>", ".", ",", "__", "\x00", "\x1f", "\xa0", " ", "😀", "ⅷ"]
    texts = ["".join(draw.choices(signs, k=draw.randrange(1, 30))) for _ in range(3000)]
    assert 100 < sum(bool(alignment.SETTLED.fullmatch(t)) for t in texts) < 2900
    ids, _ = tokenizers.encode(texts)
    assert ids.to_pylist() == [tokenizers.first.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_words_are_aligned_once_and_give_the_alignment_of_whole_texts():
    tokenizers = alignment.Tokenizers(alignment.Models.read(A, B))
    draw = random.Random(9)
    signs = [" ", " ", " ", "  ", "\n", "\t", "'ll", "'", "a", "the", "É", "ß", "x1", "22", "½", "²", "¨", "漢", "あ", "ж", "<|endoftext|>", "</s>", ".", "\xa0", "😀", "▁"]
    texts = ["".join(draw.choices(signs, k=draw.randrange(30))).encode() for _ in range(3000)]
    assert tokenizers.by_word
    encoded, encode = [], tokenizers.encode
    tokenizers.encode = lambda some: (encoded.extend(some), encode(some))[1]
    by_word = alignment.align(tokenizers, texts)
    tokenizers.by_word = False
    whole = alignment.align(tokenizers, texts)
    assert all(by_word[c].equals(whole[c]) for c in whole) and sum(n > 0 for n in whole["n_a"].to_pylist()) > 500
    tokenizers.by_word, encoded[:] = True, []
    alignment.align(tokenizers, [b"one two", b"two one two", "two é".encode()])
    assert sorted(encoded) == ["one", "two", "é"]


def test_batches_of_links_are_bounded_while_the_jobs_run(spark):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(n) for n in names]
    with alignment._bounded_batches(spark):
        assert [spark.conf.get(n) for n in names] == [str(alignment.BATCH_ROWS), str(alignment.BATCH_BYTES)]
    assert [spark.conf.get(n) for n in names] == before


def test_words_of_former_slices_are_not_encoded_again(monkeypatch):
    tokenizers = alignment.Tokenizers(alignment.Models.read(A, B))
    encode, encoded = tokenizers.encode, []
    monkeypatch.setattr(tokenizers, "encode", lambda texts: encoded.extend(texts) or encode(texts))
    first = alignment.align(tokenizers, [b"known words here", b"words again"])
    encoded.clear()
    again = alignment.align(tokenizers, [b"known words here", b"words again", b"words anew"])
    assert encoded == ["anew"]
    assert all(again[name][:2] == first[name] for name in first)


def test_forgotten_words_leave_the_others_in_place(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["und", "der", f"w{rng.randrange(400)}", f"Zahl-{rng.random()}"]) for _ in range(40)).encode() for _ in range(60)]
    plain = alignment.Tokenizers(alignment.Models.read(A, B))
    plain.by_word = False
    monkeypatch.setattr(alignment, "REMEMBERED_BYTES", 10_000)
    tokenizers, sizes = alignment.Tokenizers(alignment.Models.read(A, B)), []
    for i in range(0, 60, 5):
        got, want = alignment.align(tokenizers, texts[i : i + 5]), alignment.align(plain, texts[i : i + 5])
        assert all(got[name] == want[name] for name in want)
        sizes.append(len(tokenizers.words.words))
    assert sizes != sorted(sizes)  # some were forgotten
