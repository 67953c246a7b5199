"""Order-dependent operators over whole tables, without a single-task window.

The order columns are range-partitioned once, each row's place (partition number, position) is pinned
by a reliable checkpoint, and only one row per partition is ordered globally. Numbers and sums are
computed from these narrow rows and joined back to the table, whose other columns are never pinned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.session import pinned

_POSITION_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def ranged(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """Add ``_chunk`` and ``_pos``: the place of each row in a total order by unique ``order`` columns."""
    keys = [F.col(c) for c in order]
    spread = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    placed = pinned(spread.sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id()))
    return placed.withColumns(
        {
            "_chunk": F.shiftright("_place", _POSITION_BITS),
            "_pos": F.col("_place").bitwiseAND((1 << _POSITION_BITS) - 1),
        }
    ).drop("_place")


def _carried(placed: DataFrame, total: Column) -> DataFrame:
    """One row per chunk with the sum of ``total`` over all earlier chunks."""
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per range partition reaches this window and the broadcast below.
    return (
        placed.groupBy("_chunk")
        .agg(total.alias("_total"))
        .select("_chunk", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carry"))
    )


def _joined_back(df: DataFrame, found: DataFrame, order: list[str], name: str, narrow: list[str]) -> DataFrame:
    """``df`` with column ``name``, the ``_number`` of ``found``, by the unique ``order`` columns; nulls are equal."""
    if set(df.columns) <= set(narrow):
        return found.withColumn(name, F.col("_number")).select(*dict.fromkeys([*df.columns, name]))
    keys = {c: f"_key_{c}" for c in order}
    right = found.select(*[F.col(c).alias(k) for c, k in keys.items()], "_number")
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]
    return df.join(right, same).withColumn(name, F.col("_number")).drop(*keys.values(), "_number")


def dense_index(df: DataFrame, order: list[str], name: str = "index", partitions: int | None = None) -> DataFrame:
    """Number rows 0..n-1 in the order of unique columns.

    ``df`` is read twice: its order columns for the numbers, and its rows.
    """
    placed = ranged(df.select(*order), order, partitions)
    carried = F.broadcast(_carried(placed, F.count(F.lit(1))))
    numbered = placed.join(carried, "_chunk").withColumn("_number", F.col("_carry") + F.col("_pos"))
    return _joined_back(df, numbered, order, name, order)


def running_total(
    df: DataFrame, order: list[str], value: str, name: str, partitions: int | None = None
) -> DataFrame:
    """Running sum of ``value`` over the whole table in the order of unique columns.

    ``df`` is read twice: order columns and value for the sums, and its rows.
    """
    narrow = [*dict.fromkeys([*order, value])]
    placed = ranged(df.select(*narrow), order, partitions)
    carried = F.broadcast(_carried(placed, F.sum(value)))
    upto = Window.partitionBy("_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    within = placed.withColumn("_within", F.sum(value).over(upto)).join(carried, "_chunk")
    return _joined_back(df, within.withColumn("_number", F.col("_carry") + F.col("_within")), order, name, narrow)


def forward_fill(df: DataFrame, key: str, pos: str, values: str | list[str], partitions: int | None = None) -> DataFrame:
    """Fill nulls in ``values`` from the last earlier row of the same key; positions are unique in a key.

    A carry scan: rows are range-partitioned by (key, pos), so that a hot key is cut by its ranks however
    sparse its positions are, filled inside each part, and each part of a key hands its last values on to
    the key's next one. Parts are pinned, as both steps must see the same ones. A key has at most a row per
    range partition in the window over parts.
    """
    names = [values] if isinstance(values, str) else values
    order = [F.col(key), F.col(pos)]
    cut = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    parts = pinned(cut.withColumn("_part", F.spark_partition_id()))
    ends = parts.groupBy(key, "_part").agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(pos))).alias(f"_end_{v}") for v in names]
    )
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, "_part", *[F.last(f"_end_{v}", ignorenulls=True).over(earlier).alias(f"_carry_{v}") for v in names])
    upto = Window.partitionBy(key, "_part").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    filled = parts.withColumns({f"_filled_{v}": F.last(v, ignorenulls=True).over(upto) for v in names})
    matched = filled.alias("f").join(carried.alias("c"), F.col(f"f.{key}").eqNullSafe(F.col(f"c.{key}")) & (F.col("f._part") == F.col("c._part")))
    rest = {v: F.coalesce(f"_filled_{v}", f"_carry_{v}").alias(v) for v in names}
    return matched.select(*[rest.get(c, F.col(f"f.{c}")) for c in df.columns])
