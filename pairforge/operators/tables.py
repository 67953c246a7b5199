"""Result tables in long form: (key, column, value) rows, however ragged the source."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMPTY_MARK = "--"
BINDINGS = "array<map<string,struct<type:string,value:string>>>"
_LEAVES = T.ArrayType(
    T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("column", T.StringType()),
            T.StructField("value", T.StringType()),
        ]
    )
)


def _leaf(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _leaves(node: dict, parent: str, row: int) -> Iterator[tuple]:
    for name, value in node.items():
        for item in value if isinstance(value, list) else [value]:
            if isinstance(item, dict):
                yield from _leaves(item, name + ".", row)
            else:
                yield row, parent + name, _leaf(item)


@F.pandas_udf(_LEAVES)
def json_leaves(texts: pd.Series) -> pd.Series:
    """Leaves of one JSON text: the nesting is open-ended, which no fixed schema can express.

    Null for a text that is no JSON object or list.
    """

    def flat(text: str) -> list[tuple] | None:
        if text is None:
            return []
        try:
            data = json.loads(text)
        except (ValueError, RecursionError):
            return None
        if isinstance(data, dict):
            return list(_leaves(data, ".", 0))
        if not isinstance(data, list):
            return None
        out: list[tuple] = []
        for row, item in enumerate(data):
            out += _leaves(item, "", row) if isinstance(item, dict) else [(row, "TOPLEVEL", _leaf(item))]
        return out

    return texts.map(flat, na_action=None)


def flatten_json(docs: DataFrame, key: str = "id", text: str = "json") -> DataFrame:
    """Leaves of JSON results as (key, row, column, value) rows.

    A leaf is named by its parent and own key only (``item.value``). Objects inside a list are read
    as if they stood in its place, other list items are leaves. A top-level list gives plain names and
    numbers its items in ``row``. Texts that cannot be read give no rows; :func:`unreadable_json` has them.
    """
    return docs.select(key, F.inline(json_leaves(F.col(text))))


def unreadable_json(docs: DataFrame, key: str = "id", text: str = "json") -> DataFrame:
    """The (key, text) rows whose text is no JSON object or list."""
    return docs.where(F.col(text).isNotNull() & json_leaves(F.col(text)).isNull()).select(key, text)


def binding_values(docs: DataFrame, key: str | list[str] = "id", text: str = "bindings") -> DataFrame:
    """The usual result shape, a list of ``{variable: {type, value}}``, without leaving the JVM."""
    keys = [key] if isinstance(key, str) else key
    rows = docs.select(*keys, F.posexplode(F.from_json(text, BINDINGS)).alias("row", "_b"))
    cells = rows.select(*keys, "row", F.explode("_b").alias("variable", "cell"))
    parts = F.array(
        F.struct(F.concat("variable", F.lit(".type")).alias("column"), F.col("cell.type").alias("value")),
        F.struct(F.concat("variable", F.lit(".value")).alias("column"), F.col("cell.value").alias("value")),
    )
    return cells.select(*keys, F.col("row").cast("bigint").alias("row"), F.inline(parts)).where("value is not null")


def unpivoted(df: DataFrame, table: str, key: list[str] | None = None) -> DataFrame:
    """A wide table as (table, column, value) rows of text; one scan and one narrow explode."""
    keys = key or []
    names = [c for c in df.columns if c not in keys]
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names]
    return df.select(F.lit(table).alias("table"), *keys, F.inline(F.array(*cells)))


def present(value: Column) -> Column:
    """Whether a cell holds a value: not null, not NaN and not the empty mark."""
    return value.isNotNull() & (value != EMPTY_MARK) & (value != "NaN")


def kept_columns(values: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Columns with at least one value and a real name, with their number of values."""
    groups = [*(by or ["table"]), "column"]
    counted = values.groupBy(*groups).agg(F.count_if(present(F.col("value"))).alias("n_values"))
    return counted.where((F.col("n_values") > 0) & ~F.contains(F.col("column"), F.lit("Unnamed:")))
