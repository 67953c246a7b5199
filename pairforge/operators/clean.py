"""Cleaning of query records (``query``, ``metadata``), all narrow transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions import text as tx
from pairforge.session import pinned


def first_metadata(records: DataFrame) -> DataFrame:
    """``metadata`` array to the description and context of its first item."""
    return records.withColumns(
        {
            "description": F.get("metadata", F.lit(0))["description"],
            "context": F.get("metadata", F.lit(0))["context"],
        }
    ).drop("metadata")


def clean_queries(records: DataFrame) -> DataFrame:
    """Normalise query, description and context, and cut what precedes SELECT."""
    flat = first_metadata(records)
    return flat.withColumns(
        {
            "query": tx.strip_preamble(tx.normalise_text(F.col("query"))),
            "description": tx.normalise_text(F.col("description")),
            "context": tx.normalise_text(F.col("context")),
        }
    )


def remove_styling(records: DataFrame) -> DataFrame:
    """Urls out of descriptions; style attributes, then markup, out of contexts."""
    return records.withColumns(
        {
            "description": tx.clean_description(F.col("description")),
            "context": tx.clean_context(F.col("context")),
        }
    )


def strip_comments(records: DataFrame) -> DataFrame:
    return records.withColumn("query", tx.strip_comments(F.col("query")))


def shorter_than(records: DataFrame, text: str = "query", words: int = 300) -> DataFrame:
    return records.where(tx.word_count(F.col(text)) < words)


def drop_ids(records: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not listed. The size of the list decides, at run time, how the join runs."""
    return records.join(ids.select(key), key, "left_anti")


def drop_exact_copies(records: DataFrame, text: Column, key: str = "id") -> DataFrame:
    """Keep the lowest key of each normalised text.

    Normalising is the costly part, so each text is read once and its 256-bit digest pinned with its
    key. Digests are folded on the map side, and only the keys of later copies meet the records again:
    a corpus with few copies is not shuffled.
    """
    digests = pinned(records.select(F.sha2(text, 256).alias("_digest"), key))
    repeated = digests.groupBy("_digest").agg(F.min(key).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    copies = digests.join(repeated, "_digest").where(F.col(key) != F.col("_first")).select(key)
    return records.join(copies, key, "left_anti")


def first_rows(records: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The first n rows by key; -1 keeps all."""
    return records if n == -1 else records.orderBy(order).limit(n)
