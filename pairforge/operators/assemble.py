"""Typed train/validation/test tables from queries, instructions and complexity labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.functions.sampling import draw
from pairforge.operators.clean import drop_ids
from pairforge.operators.ordered import dense_index

SPLITS = ["full", "train", "validation", "test"]
PUBLISHED = {
    "id": "bigint",
    "instructions": "array<string>",
    "sparql_raw": "string",
    "sparql_annotated": "string",
    "sparql_query": "string",
    "complexity": "string",
    "complexity_description": "string",
    "query_results": "string",
}


def reindexed_without(records: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Drop listed ids, then number what is left 0..n-1 in key order."""
    return dense_index(drop_ids(records, ids, key), [key], "index")


def enriched(queries: DataFrame, instructions: DataFrame, complexities: DataFrame, key: str = "id") -> DataFrame:
    """Queries with their instructions and complexity; missing ones are null. Keys are unique on each side."""
    return queries.join(instructions, key, "left").join(complexities, key, "left")


def routed(splits: dict[str, DataFrame], variant: str | None = None) -> DataFrame:
    """One table of all splits with a ``split`` column."""
    unknown = set(splits) - set(SPLITS)
    if unknown:
        raise ValueError(f"unknown splits {sorted(unknown)}; use {SPLITS}")
    parts = [df.withColumn("split", F.lit(name)) for name, df in splits.items()]
    table = reduce(DataFrame.unionByName, parts)
    return table if variant is None else table.withColumn("variant", F.lit(variant))


def published(records: DataFrame, extra: list[str] | None = None, id_type: str = "bigint") -> DataFrame:
    """Cast-select to the published types; a value outside its type is an error, not a null.

    ``id_type="smallint"`` gives the 16-bit ids of small published tables.
    """
    types = {**PUBLISHED, "id": id_type}
    return records.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()], *(extra or []))


def first_instruction(records: DataFrame) -> DataFrame:
    return records.withColumn("instruction", F.get("instructions", F.lit(0)))


def first_instructions(records: DataFrame, k: int = 1) -> DataFrame:
    """One row per each of the first k instructions."""
    return records.withColumn("instruction", F.explode(F.slice("instructions", 1, k)))


def sampled_instructions(records: DataFrame, k: int = 1, seed: int = 0, key: str = "id") -> DataFrame:
    """k draws with replacement per row, by hash of (key, draw, seed): the same on every run and partitioning."""
    spot = lambda i: F.pmod(draw(seed, key, i), F.size("instructions")).cast("int")
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda i: F.struct(i.alias("draw"), F.get("instructions", spot(i)).alias("instruction")),
    )
    return records.where(F.size("instructions") > 0).select("*", F.inline(draws))
