"""Readers of the file shapes the corpus comes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.sources import ranges

RAW_QUERY = "query string, metadata array<struct<description:string,context:string>>"
PAGE = "page_id bigint, title string, text string"


def json_records(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Files that hold one JSON array of records. Read by schema, in byte ranges: one file is many tasks."""
    return ranges.json_objects(spark, path, schema)


def json_array_texts(docs: DataFrame, schema: str, text: str = "value") -> DataFrame:
    """Records of texts that each hold one JSON array, such as one array per line of a file."""
    return docs.select(F.inline(F.from_json(text, f"array<struct<{schema}>>")))


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def columnar_rows(docs: DataFrame, columns: list[str], text: str = "json") -> DataFrame:
    """Column-oriented JSON texts (``{column: {"0": v, …}}``) to rows; cells a column lacks are null.

    ``docs`` needs a ``doc`` column that names each text. Cells are folded to rows by (doc, idx).
    """
    table = F.from_json(text, "map<string,map<string,string>>")
    cells = docs.select("doc", F.explode(table).alias("column", "cells")).select(
        "doc", "column", F.explode("cells").alias("idx", "value")
    )
    return _rows_of_cells(cells, columns)


def _rows_of_cells(cells: DataFrame, columns: list[str]) -> DataFrame:
    wanted = [F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns]
    return cells.groupBy("doc", F.col("idx").cast("bigint").alias("idx")).agg(*wanted)


def columnar_json(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Files of column-oriented JSON to rows of (doc, idx, columns); ``doc`` is the file. Read in byte ranges."""
    return _rows_of_cells(ranges.columnar_cells(spark, path), columns)


def table_by_suffix(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, lines: bool = False
) -> DataFrame:
    """Parquet or JSON by the ending of the path; anything else is an error.

    A JSON file holds one array of records, or with ``lines`` one record per line.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    if path.endswith((".parquet", ".parquet.gzip")):
        return reader.parquet(path)
    if path.endswith(".json"):
        return reader.option("multiLine", not lines).json(path)
    raise ValueError(f"unknown table format: {path}; use .parquet, .parquet.gzip or .json")


def csv_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes; text columns unless a schema is given.

    Read in byte ranges: one file is many tasks, whatever its cells hold.
    """
    return ranges.csv_records(spark, path, schema)


def mapping_pairs(lines: DataFrame, text: str = "value") -> DataFrame:
    """Lines ``<a>, <b>`` to distinct (a, b) pairs without blanks and brackets around the names."""
    parts = F.split(text, ",", -1)
    clean = lambda i: F.btrim(F.get(parts, F.lit(i)), F.lit("< >"))
    return lines.select(clean(0).alias("a"), clean(1).alias("b")).where("b is not null").distinct()


def column_mapping(spark: SparkSession, path: str | None) -> DataFrame:
    """Gold column pairs; no path or a missing file means no pairs."""
    none = spark.createDataFrame([], "a string, b string")
    if path is None:
        return none
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return none
    return mapping_pairs(spark.read.text(path))


def pages(spark: SparkSession, path: str, titles: list[str] | None = None) -> DataFrame:
    """Pages of a dump (parquet with :data:`PAGE` columns); the title filter is pushed into the scan."""
    table = spark.read.schema(PAGE).parquet(path)
    return table if titles is None else table.where(F.col("title").isin(titles))


def dataset(spark: SparkSession, root: str, subset: str | None = None, split: str | None = None) -> DataFrame:
    """A published dataset; ``subset`` names a folder and ``split`` prunes partitions. How it is cut into shards does not show."""
    table = spark.read.parquet(f"{root}/{subset}" if subset else root).drop("shard")
    return table if split is None else table.where(F.col("split") == split)


def neighbour_index(docs: DataFrame, text: str = "value") -> DataFrame:
    """Few-shot index texts (``{"0": [592, …], …}``) to (query_id, rank, base_id) rows."""
    index = F.from_json(text, "map<string,array<bigint>>")
    lists = docs.select(F.explode(index).alias("key", "ids"))
    return lists.select(
        F.col("key").cast("bigint").alias("query_id"), F.posexplode("ids").alias("pos", "base_id")
    ).select("query_id", (F.col("pos") + 1).alias("rank"), "base_id")


def parsed_bindings(text: Column) -> Column:
    """Result bindings; text that is no list of bindings gives null."""
    return F.from_json(text, "array<map<string,map<string,string>>>")
