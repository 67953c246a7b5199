"""Alignment of two tokenizers over the same bytes, as Arrow arrays from tokens to links.

Each text is encoded twice. No token of either tokenizer reaches over a blank between two words, so each
different word of a slice is aligned once, and texts are put together from their words; a worker remembers
words of former slices, up to a bound in bytes, first those that came again. Texts with signs
that Unicode versions read differently, and words that do not come back, are aligned as whole texts, as
all texts are with tokenizers of another kind. Token lists are flattened with their parent indices, entries become byte
lengths, and cumulative sums give the ends of the tokens. An Acero join of both ends (an end of the
whole slice names its document too) yields every end of either side once; sorted and filled backwards
it holds one row per pair of tokens that share bytes, and the rows where both sides end cut the
document into groups. Partial document counts of id pairs come from ``Table.group_by`` in each task
and are merged by Spark.

The links of each row are stored with a row number in the shared folder. To look their counts up
again, the :data:`FREQUENT` most frequent pairs are broadcast (a fixed bound), which covers almost all
links of any size of corpus; links of other pairs, each at most one in :data:`FREQUENT` of all, are
joined by pair. Both ways always run. The highest count of each id of the first tokenizer is at most
one row per vocabulary entry.

A text is null, empty, or comes back with other bytes from one of the tokenizers: it has no tokens,
and counts are zero. Very long texts are a slice of their own; repeated rows and keys and null keys
count row by row, as documents of their own; an empty table gives no rows; only ``key`` and ``text``
are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import os
import re
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import arrow_map, keyed, shared_path, slices, texts_of

#: Pairs whose counts are broadcast.
FREQUENT = 1 << 18
#: Pairs a task counts before it hands them on.
HELD = 1 << 20
SLICE_BYTES = 2_500_000
#: Bytes of an Arrow batch that carries texts or links, and its rows at most.
BATCH_BYTES, BATCH_ROWS = 3_000_000, 2_000
#: Texts or words encoded at once; the encodings of the first tokenizer are large.
ENCODED = 2_000
#: Bytes of a row group of stored links, which a task holds until it is written.
GROUP_BYTES = 16_000_000
#: Bytes of aligned words that a worker remembers from slice to slice.
REMEMBERED_BYTES = 40_000_000
#: Links a task looks at in one piece.
SLICE_LINKS = 500_000
#: A blank between two words. Which signs are letters, numbers or blanks depends on the Unicode version of
#: the library, so only texts of signs that never changed are cut there.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
CUT = "\0"  # no settled sign
SETTLED = re.compile("[\t\n\r\x20-\x7e\xa1-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u045f\u2010-\u2027\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5]*")


@dataclass(frozen=True)
class Models:
    """The files of both tokenizers: a byte-level BPE (JSON) and a sentence-piece model."""

    first: bytes
    second: bytes

    @classmethod
    def read(cls, first: str, second: str) -> Models:
        with open(first, "rb") as a, open(second, "rb") as b:
            return cls(a.read(), b.read())

    @property
    def digest(self) -> str:
        return hashlib.sha256(self.first + b"\0" + self.second).hexdigest()


def _byte_signs() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for signs from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers of a worker, and the bytes of their entries as Arrow arrays."""

    def __init__(self, models: Models):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.first = Tokenizer.from_buffer(models.first)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_proto=models.second)
        signs = _byte_signs()
        sizes = self.first.get_vocab_size(), self.second.get_piece_size()
        entries = [self.first.id_to_token(i) or "" for i in range(sizes[0])]
        a = [bytes(signs[c] for c in e) if all(c in signs for c in e) else e.encode() for e in entries]
        b = [self._piece(self.second.id_to_piece(i)) for i in range(sizes[1])]
        self.entries = pa.array(a, pa.binary()), pa.array(b, pa.binary())
        self.lengths = [pc.binary_length(e).cast(pa.int64()) for e in self.entries]
        self.codes = sizes[1]
        self.by_word = self._is_by_word(pre_tokenizers.ByteLevel)
        self.words = Words(self)

    def _is_by_word(self, byte_level: type) -> bool:
        """Whether no token of either tokenizer can reach over a blank between two words, so that words are encoded alone.

        The first cuts there before merging. The second merges by rank, and none of its pieces goes on with a blank.
        """
        first, second = self.first, self.second
        cuts = isinstance(first.pre_tokenizer, byte_level) and first.pre_tokenizer.use_regex and not first.pre_tokenizer.add_prefix_space
        pieces = [i for i in range(self.codes) if not (second.is_byte(i) or second.is_control(i) or second.is_unknown(i))]
        ranked = all(second.get_score(i) == int(second.get_score(i)) for i in pieces)
        return cuts and first.normalizer is None and ranked and not any(re.search("[^▁]▁", second.id_to_piece(i)) for i in pieces)

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        kind, a, b = pa.list_(pa.int32()), [], []
        for i in range(0, len(texts), ENCODED):
            some = texts[i : i + ENCODED]
            a.append(pa.array([e.ids for e in self.first.encode_batch_fast([" " + t for t in some], add_special_tokens=False)], kind))
            b.append(pa.array(self.second.encode(some, num_threads=1), kind))
        return tuple(pa.concat_arrays([pa.array([], kind), *x]) for x in (a, b))


_LOADED: dict[str, Tokenizers] = {}  # of this Python worker, by digest of the files


def _tokenizers(held, digest: str) -> Tokenizers:
    if digest not in _LOADED:
        _LOADED.clear()
        pa.set_cpu_count(1)
        _LOADED[digest] = Tokenizers(held.value)
    return _LOADED[digest]


def _same_bytes(lists: pa.ListArray, entries: pa.Array, texts: list[bytes]) -> list[bool]:
    """Whether the entries of each list, joined, are the text after one space."""
    pieces = entries.take(lists.flatten())
    data = memoryview(pieces.buffers()[2] or b"").cast("B")
    ends = np.frombuffer(pieces.buffers()[1], np.int32)[: len(pieces) + 1][lists.offsets.to_numpy()]
    return [data[ends[i] : ends[i + 1]] == b" " + t for i, t in enumerate(texts)]


def _ends(lists: pa.ListArray, lengths: pa.Array, name: str) -> tuple[pa.Table, np.ndarray]:
    ids = pc.list_flatten(lists)
    ends = pc.cumulative_sum(lengths.take(ids))
    parents = pc.list_parent_indices(lists).to_numpy()
    whole = np.zeros(len(lists) + 1, np.int64)
    np.maximum.at(whole, parents + 1, ends.to_numpy())
    return pa.table({"end": ends, name: ids}), np.maximum.accumulate(whole)


def _joined(ids: pa.Array, offsets: np.ndarray, sign: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), ids), sign)


@dataclass(frozen=True)
class Aligned:
    """The tokens of some texts: whether both tokenizers give them back, counts, groups and links (``a * pieces + b``)."""

    same: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: pa.Array
    links: pa.ListArray

    def filter(self, rows: pa.Array) -> Aligned:
        of = rows.to_numpy(zero_copy_only=False)
        return Aligned(*[n[of] for n in (self.same, self.n_a, self.n_b, self.n_groups)], self.groups.filter(rows), self.links.filter(rows))

    def plus(self, more: Aligned) -> Aligned:
        numbers = zip((self.same, self.n_a, self.n_b, self.n_groups), (more.same, more.n_a, more.n_b, more.n_groups), strict=True)
        return Aligned(
            *[np.concatenate(n) for n in numbers], pa.concat_arrays([self.groups, more.groups]), pa.concat_arrays([self.links, more.links])
        )


def _aligned_whole(tokenizers: Tokenizers, texts: list[bytes]) -> Aligned:
    """Each text at once; none may be empty."""
    a, b = tokenizers.encode([t.decode() for t in texts])
    same = np.array(_same_bytes(a, tokenizers.entries[0], texts), bool) & np.array(_same_bytes(b, tokenizers.entries[1], texts), bool)
    a, b = a.filter(pa.array(same)), b.filter(pa.array(same))
    first, whole = _ends(a, tokenizers.lengths[0], "a")
    second, _ = _ends(b, tokenizers.lengths[1], "b")
    table = first.join(second, keys="end", join_type="full outer", use_threads=False).sort_by("end").combine_chunks()
    ends = table["end"].to_numpy()
    has_a, has_b = (pc.is_valid(table[c]).to_numpy().astype(bool) for c in "ab")
    cuts = np.flatnonzero(has_a & has_b)
    groups = [
        _joined(ids.cast(pa.string()), np.concatenate([[0], np.cumsum(has)[cuts]]), ",")
        for ids, has in ((first["a"].combine_chunks(), has_a), (second["b"].combine_chunks(), has_b))
    ]
    lines = pc.binary_join_element_wise(*groups, "|")
    group_ends, link_ends = np.searchsorted(ends[cuts], whole, "right"), np.searchsorted(ends, whole, "right")
    codes = pc.add(
        pc.multiply(pc.fill_null_backward(table["a"]).cast(pa.int64()), tokenizers.codes), pc.fill_null_backward(table["b"]).cast(pa.int64())
    )

    # Back to all texts: those without tokens have empty lists.
    upto = np.concatenate([[0], np.cumsum(same)])
    counted = lambda numbers: np.diff(np.asarray(numbers)[upto])
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    return Aligned(
        same,
        counted(a.offsets.to_numpy() - a.offsets[0].as_py()),
        counted(b.offsets.to_numpy() - b.offsets[0].as_py()),
        counted(group_ends),
        _joined(lines, group_ends[upto], ";"),
        pa.ListArray.from_arrays(pa.array(link_ends[upto].astype(np.int32)), codes),
    )


class Words:
    """The words that a worker has aligned, with their tokens; when they are too many, those that came only once go."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.words, self.aligned = pa.array([], pa.binary()), _aligned_whole(tokenizers, [])
        self.again = np.zeros(0, bool)

    def places(self, words: pa.Array) -> np.ndarray:
        """The place of each of some different words in ``aligned``; new ones are aligned first."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        known = at >= 0
        self.again[at[known]] = True
        if self.words.nbytes + self.aligned.groups.nbytes + self.aligned.links.nbytes > REMEMBERED_BYTES:
            kept = self.again.copy()
            if 2 * kept.sum() > len(kept):
                kept[:] = False
                kept[at[known]] = True
            at[known] = (np.cumsum(kept) - 1)[at[known]]
            rows = pa.array(kept)
            self.words, self.aligned, self.again = self.words.filter(rows), self.aligned.filter(rows), np.zeros(kept.sum(), bool)
        new = words.filter(pa.array(~known))
        if len(new):
            at[~known] = len(self.words) + np.arange(len(new))
            self.aligned = self.aligned.plus(_aligned_whole(self.tokenizers, new.to_pylist()))
            self.words, self.again = pa.concat_arrays([self.words, new]), np.append(self.again, np.zeros(len(new), bool))
        return at


def _aligned_by_word(tokenizers: Tokenizers, texts: list[str]) -> Aligned:
    """Settled texts: each different word of the slice is aligned once, and texts are put together from their words."""
    listed = pc.split_pattern(pa.array([BETWEEN.sub(CUT, t) for t in texts], pa.string()), CUT)
    coded = listed.flatten().dictionary_encode()
    index, offsets = tokenizers.words.places(coded.dictionary.cast(pa.binary()))[coded.indices.to_numpy()], listed.offsets.to_numpy()
    words, at, begins = tokenizers.words.aligned, pa.array(index), offsets[:-1]
    links = words.links.take(at)
    return Aligned(
        np.logical_and.reduceat(words.same[index], begins),
        *[np.add.reduceat(n[index], begins) for n in (words.n_a, words.n_b, words.n_groups)],
        pc.binary_join(pa.ListArray.from_arrays(listed.offsets, words.groups.take(at)), ";"),
        pa.ListArray.from_arrays(pa.array(links.offsets.to_numpy()[offsets]), links.values),
    )


def align(tokenizers: Tokenizers, texts: list[bytes]) -> dict[str, pa.Array]:
    """Columns of one slice: n_a, n_b, n_groups, groups, links (``a * pieces + b``, by place)."""
    wanted = [i for i, t in enumerate(texts) if t]
    read = {i: texts[i].decode() for i in wanted}
    cut = [i for i in wanted if tokenizers.by_word and SETTLED.fullmatch(read[i])]
    parts = []  # (rows, what is known of them)
    if cut:
        made = _aligned_by_word(tokenizers, [read[i] for i in cut])
        parts.append((np.array(cut)[made.same], made))
        cut = np.array(cut)[made.same]  # a word that does not come back is judged within its text
    rest = sorted(set(wanted) - set(map(int, cut)))
    if rest:
        made = _aligned_whole(tokenizers, [texts[i] for i in rest])
        parts.append((np.array(rest)[made.same], made))

    def placed(of, none: pa.Array) -> pa.Array:
        """Values of the parts by row, and an empty one for rows without tokens."""
        place = np.full(len(texts), 0)
        size, chunks = 1, [none]
        for rows, part in parts:
            place[rows] = size + np.arange(len(rows))
            chunks.append(of(part).filter(pa.array(part.same)))
            size += len(rows)
        return pa.concat_arrays(chunks).take(pa.array(place))

    zero = pa.array([0], pa.int64())
    return {
        "n_a": placed(lambda x: pa.array(x.n_a, pa.int64()), zero),
        "n_b": placed(lambda x: pa.array(x.n_b, pa.int64()), zero),
        "n_groups": placed(lambda x: pa.array(x.n_groups, pa.int64()), zero),
        "groups": placed(lambda x: x.groups, pa.array([""])),
        "links": placed(lambda x: x.links, pa.array([[]], pa.list_(pa.int64()))),
    }


def aligned(docs: DataFrame, models: Models, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, groups, links) of each row; ``groups`` as ``a1,a2|b1;a3|b2,b3``."""
    own = keyed(docs, key, text)
    held, digest = docs.sparkSession.sparkContext.broadcast(models), models.digest

    def work(batch):
        texts = texts_of(batch)
        for begin, end in slices(texts, SLICE_BYTES):
            yield {"id": batch.column("id")[begin:end]} | align(_tokenizers(held, digest), texts[begin:end])
            pa.default_memory_pool().release_unused()  # idle workers stay, and share the memory of their machine

    schema = f"id {dict(own.dtypes)['id']}, n_a bigint, n_b bigint, n_groups bigint, groups string, links array<bigint>"
    return arrow_map(own, work, schema).withColumnRenamed("id", key)


@contextmanager
def _bounded_batches(spark):
    """Arrow batches of few bytes, for jobs that run at once: a row of links is many times its text."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _partial_counts(batches):
    """(code, n) of the documents of a task: distinct pairs of each, counted, handed on when many are held."""
    held: list[pa.Table] = []

    def folded() -> pa.Table:
        return pa.concat_tables(held).group_by("code", use_threads=False).aggregate([("n", "sum")]).rename_columns(["code", "n"])

    def slices_of(lists: pa.ListArray):
        """Rows of about SLICE_LINKS links, one at least."""
        ends, begin = lists.offsets.to_numpy(), 0
        while begin < len(lists):
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + SLICE_LINKS)))
            yield lists.slice(begin, min(end, len(lists)) - begin)
            begin = end

    for lists in chain.from_iterable(slices_of(batch.column("links")) for batch in batches):
        pairs = pa.table({"row": pc.list_parent_indices(lists), "code": pc.list_flatten(lists)})
        each = pairs.group_by(["row", "code"], use_threads=False).aggregate([])
        held.append(each.group_by("code", use_threads=False).aggregate([("row", "count")]).rename_columns(["code", "n"]))
        if sum(t.num_rows for t in held) > HELD:
            held = [folded()]
            if held[0].num_rows > HELD // 2:
                yield from held.pop().to_batches(max_chunksize=100_000)
    if held:
        yield from folded().to_batches(max_chunksize=100_000)


def pair_counts(rows: DataFrame, pieces: int) -> DataFrame:
    """(code, n, best): in how many rows each pair is linked, and whether no pair of its first id has more."""
    counted = rows.select("links").mapInArrow(_partial_counts, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    path = shared_path(rows.sparkSession, "pair-counts")
    with _bounded_batches(rows.sparkSession):
        counted.withColumn("a", F.expr(f"code div {pieces}")).write.parquet(path)
    stored = rows.sparkSession.read.parquet(path)
    highest = stored.groupBy("a").agg(F.max("n").alias("most"))  # one row per vocabulary entry at most
    return stored.join(F.broadcast(highest), "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(docs: DataFrame, models: Models, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row; runs jobs while it is built."""
    spark = docs.sparkSession
    made = aligned(docs, models, key, text)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    path = shared_path(spark, "aligned")
    numbered = made.select(F.monotonically_increasing_id().alias("row"), F.struct(key).alias("own"), "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "links")
    with _bounded_batches(spark):
        numbered.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    rows = spark.read.parquet(path)
    pieces = Tokenizers(models).codes
    counts = pair_counts(rows, pieces)
    frequent = counts.orderBy(F.desc("n"), "code").limit(FREQUENT)
    links = rows.select("row", F.explode("links").alias("code"))
    common = links.join(F.broadcast(frequent), "code")
    rare = links.join(F.broadcast(frequent.select("code")), "code", "left_anti").join(counts, "code")
    sums = (
        common.unionByName(rare)
        .groupBy("row")
        .agg(F.count(F.lit(1)).alias("n_links"), F.sum(F.col("best").cast("bigint")).alias("n_best"), F.sum("n").alias("count_sum"))
    )
    zero = lambda name: F.coalesce(name, F.lit(0).cast("bigint")).alias(name)
    return rows.drop("links").join(sums, "row", "left").select(
        F.col("own")[key].alias(key), "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256"
    )
