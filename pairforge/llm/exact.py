"""Exact dedup by content sort.

Sampled splitters range-partition the texts by their bytes, the external sort of each partition puts
equal texts side by side, and the window over the sorted rows compares each text with its neighbour
in full. The splitters see a short lead of the bytes and a hash, so that what is sampled to place
them stays small however long the texts are; equality is always decided on the whole text.

Texts with very many copies are cut into runs: the ``hot`` most frequent contents are counted first
by hash (any other content holds less than 1/hot of all rows), their rows are salted by key, and the
few rows that stand for a run are merged by full text afterwards.

Null texts count as empty; repeated rows of one key are copies of each other and one of them stays;
null keys order last and stay only where no other key has the text; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_CONTENTS = 1000
RUN_ROWS = 64
MOST_RUNS = 4096
LEAD_CHARACTERS = 32


def _hot(rows: DataFrame) -> DataFrame:
    """(spread, runs) of the most frequent contents: at most HOT_CONTENTS rows."""
    counted = rows.groupBy("spread").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > RUN_ROWS)
    first = counted.orderBy(F.desc("n"), "spread").limit(HOT_CONTENTS)
    return first.select("spread", F.least(F.lit(MOST_RUNS), F.ceil(F.col("n") / RUN_ROWS)).cast("int").alias("runs"))


def _salted(rows: DataFrame, key: str, text: str, normalise: Callable[[Column], Column] | None) -> DataFrame:
    """Our own columns, the row's other columns packed, and the salt of hot contents."""
    content = F.coalesce(F.col(text), F.lit(""))
    own = rows.select(
        F.col(key).alias("id"),
        (normalise(content) if normalise else content).alias("content"),
        F.struct(*rows.columns if normalise else [c for c in rows.columns if c != text]).alias("row"),
        F.col(text).isNull().alias("was_null"),
    ).withColumn("spread", F.xxhash64("content"))
    hot = _hot(own.select("spread"))
    return own.join(F.broadcast(hot), "spread", "left").withColumns(
        {
            "lead": F.substring("content", 1, LEAD_CHARACTERS),
            "salt": F.when(F.col("runs").isNull(), 0).otherwise(F.pmod(F.hash("id"), F.col("runs"))),
        }
    )


def _sorted_runs(salted: DataFrame, smallest: bool) -> DataFrame:
    """Range-partitioned, sorted, and compared with their neighbours: place, best and size in the run."""
    run = Window.partitionBy("lead", "spread", "salt", "content").orderBy(
        F.asc_nulls_last("id") if smallest else F.desc_nulls_last("id")
    )
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return salted.repartitionByRange("lead", "spread", "salt").select(
        "*",
        F.row_number().over(run).alias("place"),
        F.first("id").over(whole).alias("best"),
        F.count(F.lit(1)).over(whole).alias("n"),
        F.sha2("content", 256).alias("digest"),
    )


def _decided(rows: DataFrame, key: str, text: str, smallest: bool, normalise) -> DataFrame:
    salted = _salted(rows, key, text, normalise)
    runs = _sorted_runs(salted, smallest)
    # One row per run of a hot content, from hot rows alone; the merged table has at most HOT_CONTENTS rows.
    merged = (
        _sorted_runs(salted.where(F.col("runs").isNotNull()).drop("row", "was_null"), smallest)
        .where(F.col("place") == 1)
        .groupBy("content", "digest")
        .agg((F.min if smallest else F.max)("best").alias("all_best"), F.sum("n").alias("all_n"))
        .drop("content")
    )
    joined = runs.join(F.broadcast(merged), "digest", "left")
    keep = F.when(F.col("all_n").isNull(), F.col("best")).otherwise(F.col("all_best"))
    return joined.withColumns(
        {
            "keep_id": keep,
            "group_size": F.coalesce("all_n", "n"),
            "kept": (F.col("place") == 1) & F.col("id").eqNullSafe(keep),
        }
    )


def exact_groups(
    rows: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    smallest: bool = True,
    normalise: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per input row: ``key``, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    decided = _decided(rows, key, text, smallest, normalise)
    return decided.select(F.col("id").alias(key), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def drop_exact(
    rows: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    smallest: bool = True,
    normalise: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """The rows that stay, with their own columns."""
    kept = _decided(rows, key, text, smallest, normalise).where("kept")
    if normalise:
        return kept.select("row.*")
    whole = {c: F.col("row")[c] for c in rows.columns if c != text}
    whole[text] = F.when(~F.col("was_null"), F.col("content"))
    return kept.select(*[whole[c].alias(c) for c in rows.columns])
