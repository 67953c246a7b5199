"""Few-shot retrieval: exact cosine top-k, ordered neighbour lists, prompt blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.fixed_values import END_TAG, START_TAG
from pairforge.functions.text import word_count
from pairforge.session import shared_path

BLOCK_BYTES = 32 << 20  # float64 vectors of one block, and one slice of its similarities
MERGE_GROUPS = 64  # of base tasks, in the first of two merges
RANKED = pa.schema([("query_id", pa.int64()), ("base_id", pa.int64()), ("similarity", pa.float64())])
RANKED_DDL = "query_id bigint, base_id bigint, similarity double"


def _unit_rows(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    if not rows:
        return np.zeros((0, 0))
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = np.concatenate([np.asarray(c.flatten(), dtype=np.float64) for c in chunks])
    vectors = flat.reshape(rows, -1)
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)


def _cut(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row: by similarity, then by id. Only what ties with the k-th is sorted."""
    if sims.shape[1] > 4 * k:
        least = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
        width = int((sims >= least).sum(axis=1).max())
        near = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        ids, sims = np.take_along_axis(ids, near, axis=1), np.take_along_axis(sims, near, axis=1)
    best = np.lexsort((ids, -sims), axis=1)[:, :k]
    return np.take_along_axis(ids, best, axis=1), np.take_along_axis(sims, best, axis=1)


def _nearest(asked: np.ndarray, base_ids: np.ndarray, base: np.ndarray, k: int, digits: int):
    """Ids and similarities of the k nearest base rows, a bounded slice of the matrix at a time."""
    step = max(1, BLOCK_BYTES // (8 * len(base_ids)))
    parts = []
    for at in range(0, len(asked), step):
        # Rounded, so that copies tie and the lower id wins.
        sims = np.round(asked[at:at + step] @ base.T, digits)
        parts.append(_cut(np.broadcast_to(base_ids, sims.shape), sims, k))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _by_length(rows: pa.Table, key: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Keys and unit vectors of the rows, by the length of the vectors."""
    lengths = pc.list_value_length(rows["vector"])
    found = {}
    for dim in pc.unique(lengths).to_pylist():
        same = rows.filter(pc.equal(lengths, dim))
        found[dim] = same[key].to_numpy(), _unit_rows(same["vector"], same.num_rows)
    return found


def _base_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += 8 * len(batch.column("vector").flatten())
        if size >= block_bytes:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _query_blocks(files: list[str], rows: int) -> Iterator[pa.Table]:
    for uri in files:
        filesystem, path = pafs.FileSystem.from_uri(uri)
        with filesystem.open_input_file(path) as file:
            for batch in pq.ParquetFile(file).iter_batches(rows, columns=["query_id", "vector"]):
                yield pa.Table.from_batches([batch])


def _block_top_k(files: list[str], k: int, digits: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _base_blocks(batches, block_bytes):
            base = _by_length(block, "base_id")
            for queries in _query_blocks(files, max(1, block_bytes // (8 * max(base)))):
                for dim, (query_ids, asked) in _by_length(queries, "query_id").items():
                    if dim in base:
                        ids, sims = _nearest(asked, *base[dim], k, digits)
                        columns = np.repeat(query_ids, ids.shape[1]), ids.ravel(), sims.ravel()
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=RANKED)

    return run


def _best(rows: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("similarity"), "base_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _usable() -> Column:
    return F.coalesce((F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull()), F.lit(False))


def odd_vectors(rows: DataFrame, dim: int) -> DataFrame:
    """The rows that nothing of length ``dim`` is compared with: no vector, another length, or nulls in it."""
    return rows.where(~(_usable() & F.coalesce(F.size("vector") == dim, F.lit(False))))


def cosine_top_k(
    queries: DataFrame, base: DataFrame, k: int = 10, digits: int = 9, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The k most similar base rows of each query row, exactly: (query_id, base_id, similarity, rank).

    ``queries(query_id, vector)``, ``base(base_id, vector)``. The queries are stored once in the shared
    folder, while the query is built. The base is read in place, ``block_bytes`` of vectors at a time,
    and each block meets the stored queries in blocks of that size; a matrix product keeps the k best
    base rows of each query, so pairs are never emitted and a task holds two blocks, however many
    queries there are. The rows of a task are cut to k per query before they are shuffled, then merged
    by query and group of tasks, then by query. Similarities are rounded to ``digits`` and ties go to
    the lower id. Only vectors of equal length are compared; null and empty vectors and those with
    nulls take no part. :func:`odd_vectors` reports what does not fit a length.
    """
    path = shared_path(queries.sparkSession, "queries")
    queries.where(_usable()).select(F.col("query_id").cast("bigint"), "vector").write.parquet(path)
    files = queries.sparkSession.read.schema("query_id bigint").parquet(path).inputFiles()
    vectors = base.where(_usable()).select(F.col("base_id").cast("bigint"), "vector")
    partial = vectors.mapInArrow(_block_top_k(files, k, digits, block_bytes), RANKED_DDL)
    grouped = partial.withColumn("_group", F.spark_partition_id() % MERGE_GROUPS)
    return _best(_best(grouped, k, "query_id", "_group").drop("rank", "_group"), k, "query_id")


def neighbour_lists(ranked: DataFrame) -> DataFrame:
    """Base ids of each query in rank order; at most k per list."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "base_id")))
    return ranked.groupBy("query_id").agg(F.transform(ordered, lambda x: x["base_id"]).alias("neighbours"))


def neighbour_rows(lists: DataFrame) -> DataFrame:
    """The reverse of :func:`neighbour_lists`."""
    return lists.select("query_id", F.posexplode("neighbours").alias("rank", "base_id")).withColumn(
        "rank", F.col("rank") + 1
    )


def retrieval_pool(train: DataFrame, text: str = "sparql_query", words: int = 300) -> DataFrame:
    """Training rows short enough to serve as shots."""
    return train.where(word_count(F.col(text)) < words)


def shot(instruction: Column, query: Column, start: str = START_TAG, end: str = END_TAG) -> Column:
    return F.concat(
        F.lit("- User: "), instruction, F.lit(f"\nAnswer: Here is the SPARQL query: \n{start}\n"), query, F.lit(f"\n{end}\n")
    )


def shot_blocks(ranked: DataFrame, train: DataFrame, n: int, target: str = "sparql_query") -> DataFrame:
    """``few_shots`` text of the n nearest training rows; n = 0 gives an empty text.

    ``train(base_id, instruction, <target>)``. Neighbours that are not in it are passed over, and a
    query without any other keeps its heading alone.
    """
    if n == 0:
        return ranked.select("query_id").distinct().withColumn("few_shots", F.lit(""))
    shots = ranked.where(F.col("rank") <= n).join(train, "base_id", "left").select(
        "query_id", "rank", shot(F.col("instruction"), F.col(target)).alias("text")
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    joined = F.array_join(F.transform(ordered, lambda x: x["text"]), "")
    return shots.groupBy("query_id").agg(F.concat(F.lit("Examples:\n"), joined).alias("few_shots"))


def sweep(rows: DataFrame, **parameters: list) -> DataFrame:
    """Each row once per combination of parameter values; the lists are literals, so nothing is joined."""
    for name, values in parameters.items():
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return rows
