"""Sinks. All of them write from the executors; none gathers rows."""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.operators.assemble import published
from pairforge.operators.ordered import running_total


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("overwrite").json(path)


def write_json_arrays(df: DataFrame, path: str, pretty: bool = True) -> None:
    """Files that hold one JSON array each, a file per partition; ``pretty`` lets records run over lines."""
    text = F.to_json(F.struct(*df.columns), {"pretty": str(pretty).lower()})

    def framed(batches):
        started = False
        for batch in batches:
            if batch.num_rows:
                signs = pa.array(["," if started else "["] + [","] * (batch.num_rows - 1))
                started = True
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(signs, batch.column("value"), "")], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if started else "[]"])], names=["value"])

    df.select(text.alias("value")).mapInArrow(framed, "value string").write.mode("overwrite").text(path)


def write_columnar_json(df: DataFrame, path: str, index: str) -> None:
    """Column-oriented JSON files, ``{column: {"<index>": value, …}, …}``, one object a partition, sorted by column on disk."""
    value = lambda c: F.to_json(F.struct(F.col(c).cast("string").alias("v")), {"ignoreNullFields": "false"})
    names = [c for c in df.columns if c != index]
    cells = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column"), value(c).alias("cell")) for i, c in enumerate(names)])
    rows = df.select(F.col(index).cast("string").alias("idx"), F.inline(cells)).sortWithinPartitions("ord")

    def framed(batches):
        last = None
        for batch in batches:
            lines = []
            for column, idx, cell in zip(*(batch.column(c).to_pylist() for c in ("column", "idx", "cell")), strict=True):
                opening = "," if column == last else f"{'{' if last is None else '},'}{json.dumps(column)}: {{"
                lines.append(f"{opening}{json.dumps(idx)}: {cell[5:-1]}")
                last = column
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["{}" if last is None else "}}"])], names=["value"])

    rows.mapInArrow(framed, "value string").write.mode("overwrite").text(path)


def write_parquet(df: DataFrame, path: str, codec: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.option("compression", codec) if codec else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled and blanks kept, so that text survives ``csv_table``."""
    df.write.mode("overwrite").options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def write_neighbour_index(lists: DataFrame, path: str) -> None:
    """Neighbour lists as JSON maps, one small map per line: the index is never one object in memory."""
    entry = F.map_from_arrays(F.array(F.col("query_id").cast("string")), F.array("neighbours"))
    lists.select(F.to_json(entry).alias("value")).write.mode("overwrite").text(path)


def _sizes(df: DataFrame) -> Column:
    """Bytes of a row's texts, with a word for each of them and for each number."""
    parts = []
    for name, kind in df.dtypes:
        text = F.array_join(name, "") if kind.startswith("array<string") else F.col(name).cast("string")
        parts.append(F.coalesce(F.octet_length(text), F.lit(0)) + 8)
    return reduce(lambda a, b: a + b, parts).cast("bigint")


def write_dataset(df: DataFrame, path: str, max_rows_per_file: int = 1_000_000, max_bytes_per_file: int | None = None) -> None:
    """The typed table, a folder per split, in files of bounded size.

    With ``max_bytes_per_file`` the rows of a split, by id, are cut into shards at every half of it in a running
    sum of their bytes before compression, a folder and a file each: no file is larger as long as no row
    exceeds that half. Ids are unique in a split; only ids and sizes are ordered.
    """
    rows = published(df, ["split"])
    writer = lambda frame: frame.write.mode("overwrite").option("maxRecordsPerFile", max_rows_per_file)
    if max_bytes_per_file is None:
        writer(rows).partitionBy("split").parquet(path)
        return
    sizes = rows.select("split", "id", _sizes(rows).alias("size"))
    places = running_total(sizes, ["split", "id"], "size", "upto")
    shard = F.floor((F.col("upto") - 1) / max(1, max_bytes_per_file // 2)).alias("shard")
    cut = rows.join(places.select("split", "id", shard), ["split", "id"]).select(*rows.columns, "shard")
    writer(cut.repartition("split", "shard")).partitionBy("split", "shard").parquet(path)


def write_error_map(parts: DataFrame, path: str) -> None:
    """Row numbers per message (see ``error_map``) as JSON lines."""
    write_json(parts, path)
