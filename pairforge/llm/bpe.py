"""Byte-level BPE encoding and decoding by a rank file.

Two tiers: a minimal perfect hash over the vocabulary resolves every pre-token that is a whole entry;
the others are merged by a heap of pair ranks over a linked list of their bytes. The results of a
task's recent pre-tokens are remembered, up to a bound. Nothing but the vocabulary (a file of fixed
size) is broadcast; texts stay where they are read.

Null texts count as empty and have no ids; very long pre-tokens cost n log n; repeated rows encode alike.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import struct
from array import array

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import arrow_map, keyed, texts_of

_MASK = (1 << 64) - 1
REMEMBERED = 500_000
_SHIFT = 21  # ranks are below 2**21 - 1
_NONE = (1 << _SHIFT) - 1


def _mix(h: int, displacement: int) -> int:
    z = ((h ^ (displacement * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9) & _MASK
    return z ^ (z >> 29)


class PerfectHash:
    """Bytes keys to 0..n-1 without gaps: hash, then displace; buckets of one point at their slot."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.buckets = max(1, n // 3)
        self.displaced = [0] * self.buckets
        self.slots: list[bytes | None] = [None] * n
        chains: dict[int, list[tuple[int, bytes]]] = {}
        for key in keys:
            h = xxhash.xxh3_64_intdigest(key)
            chains.setdefault(h % self.buckets, []).append((h, key))
        singles = []
        for bucket, chain in sorted(chains.items(), key=lambda c: (-len(c[1]), c[0])):
            if len(chain) == 1:
                singles.append((bucket, chain[0][1]))
                continue
            d = 0
            while True:
                places = {_mix(h, d) % n for h, _ in chain}
                if len(places) == len(chain) and all(self.slots[p] is None for p in places):
                    break
                d += 1
            self.displaced[bucket] = d
            for h, key in chain:
                self.slots[_mix(h, d) % n] = key
        free = (i for i, key in enumerate(self.slots) if key is None)
        for (bucket, key), place in zip(singles, free, strict=True):
            self.displaced[bucket] = -place - 1
            self.slots[place] = key

    def place(self, key: bytes) -> int:
        """Where the key is, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displaced[h % self.buckets]
        at = -d - 1 if d < 0 else _mix(h, d) % len(self.slots)
        return at if self.slots[at] == key else -1


class Vocabulary:
    """Ranks by perfect hash, entries by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.hash = PerfectHash(sorted(ranks))
        self.ranks = [ranks[key] for key in self.hash.slots]
        self.entries = [b""] * (max(ranks.values()) + 1)
        for key, rank in ranks.items():
            self.entries[rank] = key
        self.single = [ranks[bytes([b])] for b in range(256)]
        # Every entry that two entries make up: their ranks to its own.
        self.pairs = {
            ranks[key[:i]] << _SHIFT | ranks[key[i:]]: rank
            for key, rank in ranks.items()
            for i in range(1, len(key))
            if key[:i] in ranks and key[i:] in ranks
        }

    def rank(self, piece: bytes) -> int:
        at = self.hash.place(piece)
        return self.ranks[at] if at >= 0 else -1

    def merged(self, word: bytes) -> list[int]:
        """Ids of a pre-token that is no entry: lowest rank first, leftmost among equals.

        Parts are linked by position; the heap holds rank and position of the pairs, and a pair counts
        only while ``now`` still has its rank at its position.
        """
        n, pair, pop, push = len(word), self.pairs.get, heapq.heappop, heapq.heappush
        ids = [self.single[b] for b in word]
        ids.append(_NONE)  # stands behind the last part and, as index -1, before the first
        after, before = list(range(1, n + 2)), list(range(-1, n))
        now = [pair(left << _SHIFT | right) for left, right in itertools.pairwise(ids)]
        now.append(None)
        heap = [rank << 32 | i for i, rank in enumerate(now) if rank is not None]
        heapq.heapify(heap)
        while heap:
            top = pop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            if now[i] != rank:
                continue
            gone = after[i]
            after[i] = end = after[gone]
            before[end] = i
            ids[i], ids[gone], now[gone] = rank, -1, None
            now[i] = new = pair(rank << _SHIFT | ids[end])
            if new is not None:
                push(heap, new << 32 | i)
            b = before[i]
            now[b] = new = pair(ids[b] << _SHIFT | rank)
            if new is not None:
                push(heap, new << 32 | b)
        return [i for i in ids[:-1] if i >= 0]

    def ids(self, word: bytes) -> list[int]:
        whole = self.rank(word)
        return [whole] if whole >= 0 else self.merged(word)


class _Encoded(dict):
    """Pre-token to the bytes of its ids, remembered up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        ids = self.vocabulary.ids(token.encode())
        value = self[token] = struct.pack(f"<{len(ids)}I", *ids)
        return value


class Codec:
    """Encodes and decodes texts; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        self.known = _Encoded(vocabulary)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.entries.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a base64 entry and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(entry): int(rank) for entry, rank in map(bytes.split, lines)}


_CODECS: dict[tuple[str, str], Codec] = {}  # of this Python worker, by vocabulary and pattern


def _codec(held, pattern: str) -> Codec:
    name = held.id, pattern
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(held.value, pattern)
    return _CODECS[name]


class _Held:
    """A broadcast and the digest of what it holds, by which a reused worker knows it."""

    def __init__(self, value, digest: str):
        self._value, self.id = value, digest

    @property
    def value(self):
        return self._value.value


def _hold(docs: DataFrame, path: str) -> _Held:
    with open(path, "rb") as file:
        digest = hashlib.file_digest(file, "sha256").hexdigest()
    return _Held(docs.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(path))), digest)


def encoded(docs: DataFrame, path: str, pattern: str, *keep: str) -> DataFrame:
    """Rows with ``text`` to ``ids`` (array of ints); columns named in ``keep`` go along."""
    held, kinds = _hold(docs, path), dict(docs.dtypes)

    def work(batch):
        codec = _codec(held, pattern)
        ids = [array("i", codec.encode(t)).tolist() for t in batch.column("text").to_pylist()]
        yield {k: batch.column(k) for k in keep} | {"ids": pa.array(ids, pa.list_(pa.int32()))}

    return arrow_map(docs.select(*dict.fromkeys(["text", *keep])), work, ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["ids array<int>"]))


def decoded(rows: DataFrame, path: str, *keep: str) -> DataFrame:
    """Rows with ``ids`` back to their bytes, ``content``."""
    held, kinds = _hold(rows, path), dict(rows.dtypes)

    def work(batch):
        codec = _codec(held, "")
        out = [codec.decode(array("i", ids).tobytes()) for ids in batch.column("ids").to_pylist()]
        yield {k: batch.column(k) for k in keep} | {"content": pa.array(out, pa.binary())}

    return arrow_map(rows.select(*dict.fromkeys(["ids", *keep])), work, ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["content binary"]))


def round_trip(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each text encoded and decoded in one pass over it.

    ``with_ids`` adds the ids themselves, an array.
    """
    own = keyed(docs, key, text)
    held, kind = _hold(docs, path), dict(own.dtypes)["id"]

    def work(batch):
        codec, counts, ids_sha, decoded_sha, listed = _codec(held, pattern), [], [], [], []
        for content in texts_of(batch):
            ids = codec.encode(content.decode())
            counts.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            decoded_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            listed.append(ids)
        made = {"id": batch.column("id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": ids_sha, "decoded_sha256": decoded_sha}
        if with_ids:
            flat = pa.array(np.frombuffer(b"".join(listed), "<i4"))
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            made["ids"] = pa.ListArray.from_arrays(pa.array(ends), flat)
        yield made

    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    made = arrow_map(own, work, schema)
    return made.select(F.col("id").alias(key), *made.columns[1:])
