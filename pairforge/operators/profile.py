"""Column profiles: one row of features per (table, column) of a long value table.

Types and lengths of all cells come first; then only numeric columns are read as numbers, and only
textual ones for their characters. Each pass is one grouped aggregate, so a column with a third of
all values is folded on the map side and no cell text crosses the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.fixed_values import PUNCTUATION, SPECIAL_CHARACTERS, UNITS
from pairforge.functions.sampling import draw
from pairforge.operators.tables import present
from pairforge.session import pinned

FLOAT_TEXT = r"(?i)^\s*[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"
# A CJK date mark, or a date recognised by its shape with a year from 2000 to 2030.
_YEAR = "(?:20[0-2][0-9]|2030)"
_DAY = "(?:0?[1-9]|[12][0-9]|3[01])"
_MONTH = "(?:0?[1-9]|1[0-2])"
_MONTH_NAME = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[.]?"
DATE = (
    rf"(?i)[月日年]|^\s*(?:{_YEAR}[-/.]{_MONTH}[-/.]{_DAY}|{_DAY}[-/.]{_DAY}[-/.]{_YEAR}"
    rf"|{_MONTH_NAME} {_DAY},? {_YEAR}|{_DAY} {_MONTH_NAME},? {_YEAR})(?:[ T][0-9]{{1,2}}:[0-9]{{2}}.*)?$"
)
# Where a url has been found, more characters around it change nothing: one before the point will do.
URL = r"[-a-zA-Z0-9@:%._\+~#=]\.[a-zA-Z0-9()]{1,6}\b"
TYPES = ["url", "numeric", "date", "string"]
STATS = ["mean", "min", "max", "var", "cv", "unique"]
CHARS = ["space", "punct", "special", "digit"]
EPSILON = 1e-12
# So many columns are broadcast at most to pick their cells; beyond that they are joined.
BROADCAST_COLUMNS = 100_000
# The 24 numbers that describe a column, in feature order.
FEATURES = [
    *[f"is_{t}" for t in TYPES],
    *[f"num_{s}" for s in STATS],
    *[f"len_{s}" for s in STATS],
    *[f"{c}_mean" for c in CHARS],
    *[f"{c}_cv" for c in CHARS],
]


def is_float(value: Column) -> Column:
    return value.rlike(FLOAT_TEXT)


def _without_units(value: Column) -> Column:
    """Separators and units taken out, one-character ones in a single pass."""
    bare = F.translate(value, "," + "".join(u for u in UNITS if len(u) == 1), "")
    for unit in UNITS:
        if len(unit) > 1:
            bare = F.replace(bare, F.lit(unit), F.lit(""))
    return bare


def _among(value: Column, chars: str) -> Column:
    return F.length(value) - F.length(F.translate(value, chars, ""))


def is_mostly_digits(value: Column) -> Column:
    """At least half digits once separators and units are gone; neither of them holds digits."""
    digits = _among(value, "0123456789")
    size = F.when(value.rlike("[,+万亿萬億]"), F.length(_without_units(value))).otherwise(F.length(value))
    return (digits > 0) & (digits >= 0.5 * size)


def is_url(value: Column) -> Column:
    return F.contains(value, F.lit(".")) & value.rlike(URL)


def is_date(value: Column) -> Column:
    # Every year in range holds a 20, and few other values do: most never meet the pattern.
    likely = F.contains(value, F.lit("20")) | F.contains(value, F.lit("月")) | F.contains(value, F.lit("日"))
    return (likely | F.contains(value, F.lit("年"))) & value.rlike(DATE)


def number(value: Column) -> Column:
    """The number in a text: a float as such, else its first number times its unit."""
    bare = F.translate(value, ",", "")
    found = F.regexp_extract(bare, r"-?(?:[0-9]*[.])?[0-9]+", 0).try_cast("double")
    scale = F.lit(1)
    for unit, factor in reversed(UNITS.items()):
        scale = F.when(F.contains(bare, F.lit(unit)), factor).otherwise(scale)
    parsed = (
        F.when(is_float(value), F.trim(value).try_cast("double"))
        .when(F.contains(value, F.lit(",")) & is_float(bare), F.trim(bare).try_cast("double"))
        .otherwise(found * scale)
    )
    return F.nullif(parsed, F.lit(float("nan")))


def _ratio(value: Column, hits: Column) -> Column:
    return F.try_divide(hits, F.length(value)) + EPSILON


def character_ratios(value: Column) -> dict[str, Column]:
    """Shares of white space, punctuation, special characters and digits in a text."""

    hits = [_among(value, c) for c in (" \t\n", PUNCTUATION, SPECIAL_CHARACTERS, "0123456789")]
    return {name: _ratio(value, h) for name, h in zip(CHARS, hits)}


def _stats(prefix: str, x: str) -> list[Column]:
    """Repeated numbers fold on the map side; with one distinct count the input is not multiplied."""
    return [
        F.avg(x).alias(f"{prefix}_mean"),
        F.min(x).alias(f"{prefix}_min"),
        F.max(x).alias(f"{prefix}_max"),
        F.var_pop(x).alias(f"{prefix}_var"),
        F.try_divide(F.var_pop(x), F.avg(x)).alias(f"{prefix}_cv"),
        F.try_divide(F.count_distinct(x), F.count(x)).alias(f"{prefix}_unique"),
    ]


def _is_cell() -> Column:
    return present(F.col("value")) & ~F.contains(F.col("column"), F.lit("Unnamed:"))


def _cells(values: DataFrame) -> DataFrame:
    return values.where(_is_cell())


def _tests() -> list[Column]:
    value = F.col("value")
    return [
        is_float(value).alias("_float"), is_mostly_digits(value).alias("_digits"), is_url(value).alias("_url"),
        is_date(value).alias("_date"),
    ]


def _shares(n: Column | None = None) -> list[Column]:
    """Shares of the cells that pass the tests; ``n`` counts the cells, if not all rows are."""
    n = F.count(F.lit(1)) if n is None else n

    def share(flag: str, least: float) -> Column:
        return F.count_if(flag) >= least * n

    return [
        n.alias("n_values"),
        share("_float", 0.95).alias("strict_numeric"),
        share("_digits", 0.9).alias("mainly_numeric"),
        share("_url", 0.9).alias("_urls"),
        share("_date", 0.9).alias("_dates"),
    ]


def _typed(rows: DataFrame) -> DataFrame:
    kind = (
        F.when(F.col("_urls"), "url")
        .when(F.col("_dates"), "date")
        .when(F.col("strict_numeric") | F.col("mainly_numeric"), "numeric")
        .otherwise("string")
    )
    typed = rows.withColumn("type", kind).drop("_urls", "_dates")
    return typed.withColumns({f"is_{t}": (F.col("type") == t).cast("double") for t in TYPES})


def column_types(values: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``values(table, column, value)`` to the type of each column, with its indicators."""
    groups = [*(by or ["table"]), "column"]
    return _typed(_cells(values).select(*groups, *_tests()).groupBy(*groups).agg(*_shares()))


def typed_sets(values: DataFrame, by: list[str]) -> DataFrame:
    """:func:`column_types` with ``values``, the set of all values of a column, also of those that hold no value for its type.

    For columns of single results, whose values are in one row of the source already.
    """
    groups = [*by, "column"]
    tested = values.select(*groups, "value", _is_cell().alias("_cell"), *_tests())
    flags = [F.when(F.col("_cell"), F.col(f)).alias(f) for f in ("_float", "_digits", "_url", "_date")]
    read = tested.select(*groups, "value", "_cell", *flags)
    sets = read.groupBy(*groups).agg(
        *_shares(F.count_if("_cell")), F.collect_set("value").alias("values")
    )
    return _typed(sets.where("n_values > 0"))


def is_textual() -> Column:
    """Whether a typed column is text, or only mainly numeric: it has character features and an embedding."""
    return (F.col("type") == "string") | (~F.col("strict_numeric") & F.col("mainly_numeric"))


def column_profiles(values: DataFrame, by: list[str] | None = None) -> DataFrame:
    """:func:`column_types` with all :data:`FEATURES`.

    Numeric features are -1 for other types; character features are -1 unless the column is text or
    only mainly numeric. The types are stored while the query is built, one row per column.
    """
    groups = [*(by or ["table"]), "column"]
    value, cells = F.col("value"), _cells(values)
    read = cells.select(*groups, *_tests(), F.length(value).cast("double").alias("_len"))
    types = pinned(_typed(read.groupBy(*groups).agg(*_shares(), *_stats("len", "_len"))))
    few = types.limit(BROADCAST_COLUMNS + 1).count() <= BROADCAST_COLUMNS

    def cells_of(kind: Column) -> DataFrame:
        wanted = types.where(kind).select(*groups)
        return cells.join(F.broadcast(wanted) if few else wanted, groups)

    numeric, textual = F.col("type") == "numeric", is_textual()
    numbers = cells_of(numeric).select(*groups, number(value).alias("_num")).groupBy(*groups).agg(*_stats("num", "_num"))
    shares = [ratio.alias(f"_{name}") for name, ratio in character_ratios(value).items()]
    characters = cells_of(textual).select(*groups, *shares).groupBy(*groups).agg(
        *[F.avg(f"_{c}").alias(f"{c}_mean") for c in CHARS],
        *[F.try_divide(F.var_pop(f"_{c}"), F.avg(f"_{c}")).alias(f"{c}_cv") for c in CHARS],
    )
    return types.join(numbers, groups, "left").join(characters, groups, "left").withColumns(
        {
            **{f"num_{s}": F.when(numeric, F.col(f"num_{s}")).otherwise(-1.0) for s in STATS},
            **{f"{c}_{s}": F.when(textual, F.col(f"{c}_{s}")).otherwise(-1.0) for c in CHARS for s in ("mean", "cv")},
        }
    )


def sampled_cells(cells: DataFrame, sample: int, by: list[str] | None = None, seed: int = 0, key: str = "id") -> DataFrame:
    """Up to ``sample`` cells of each column, picked by hash of (key, seed)."""
    order = Window.partitionBy(*(by or ["table"]), "column").orderBy(draw(seed, key), key)
    return cells.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= sample).drop("_rank")


def column_embeddings(
    cells: DataFrame, by: list[str] | None = None, sample: int | None = None, seed: int = 0, key: str = "id"
) -> DataFrame:
    """Mean embedding of up to ``sample`` values per column, picked by hash of (key, seed); None takes all.

    ``cells(table, column, <key>, embedding)``. The rank limit runs before the shuffle, so each map
    task sends at most ``sample`` rows per column however many values the column has.
    """
    groups = [*(by or ["table"]), "column"]
    picked = cells if sample is None else sampled_cells(cells, sample, by, seed, key)
    dims = picked.select(*groups, F.posexplode("embedding").alias("dim", "x"))
    means = dims.groupBy(*groups, "dim").agg(F.avg("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "x")))
    return means.groupBy(*groups).agg(F.transform(ordered, lambda d: d["x"]).alias("embedding"))

