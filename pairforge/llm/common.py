"""What the operators of this subpackage share: key and text columns, folds, samples, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.session import pinned, shared_path

__all__ = ["arrow_map", "fold", "keyed", "pinned", "sampled", "shared_path", "slices", "texts_of", "with_row", "words_of"]


def keyed(rows: DataFrame, key: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """Two columns of our own, ``id`` and ``text`` (null counts as empty): other columns can't clash."""
    return rows.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *more)


def with_row(rows: DataFrame, name: str) -> DataFrame:
    """The rows with a unique number each, stored, so that it stays the same wherever they are read."""
    return pinned(rows.withColumn(name, F.monotonically_increasing_id()))


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def sampled(rows: DataFrame, limit: int, key: str = "id") -> DataFrame:
    """The rows of the ``limit`` keys that come first by hash: a bounded list of keys, broadcast back."""
    first = rows.select(key).orderBy(F.xxhash64(key), key).limit(limit).distinct()
    return rows.join(F.broadcast(first), key, "left_semi")


def arrow_map(rows: DataFrame, work: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """``work`` on each Arrow batch; it yields dicts of columns in the order of ``schema``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for columns in work(batch):
                    yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch in UTF-8, without decoding them."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; bytes know no other white space or case."""
    return text.lower().split()


def slices(texts: list[bytes], most: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``most`` bytes, one text at least, so that arrays stay bounded."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit mix of unsigned integers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        z = values.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))
