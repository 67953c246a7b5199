"""Readers of files whose records run over lines, cut into byte ranges like any text file.

Spark's text source already cuts a file at a separator (``lineSep``), wherever its blocks begin. A
separator inside a string or a nested object is no border of a record, and which ones are depends on
all that stands before. So each range is summed up first, for both answers to "does it begin inside a
string?": how many strings it opens or closes, how deep it nests, whether it ends a record. One fold
over the ranges of a file (one small row each) gives the state at every range's begin, and the second
scan cuts records. What is cut by a border of ranges is put together by record; nothing else is
shuffled, and no task needs more than its range and the longest record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Shape:
    """How records end: ``look(pieces, inside)`` gives, per piece, whether it ends inside a string and how the depth changes.

    A record ends with a piece that ends outside strings at depth ``floor`` or above it; pieces are joined by
    ``separator``, and ``closed`` puts one behind the last as well.
    """

    separator: str
    look: Callable[[pa.Array, bool], tuple[np.ndarray, np.ndarray]]
    floor: int = 0
    exact: bool = False
    closed: bool = False


def _inside(quotes: pa.Array, begins_inside: bool) -> np.ndarray:
    return (np.cumsum(quotes.to_numpy(zero_copy_only=False)) + begins_inside) % 2 == 1


def _csv_look(pieces: pa.Array, begins_inside: bool) -> tuple[np.ndarray, np.ndarray]:
    return _inside(pc.count_substring(pieces, '"'), begins_inside), np.zeros(len(pieces), np.int64)


def _json_bare(pieces: pa.Array, begins_inside: bool) -> tuple[np.ndarray, pa.Array]:
    """Which pieces end inside a string, and the pieces without strings."""
    plain = pc.replace_substring_regex(pieces, r"\\(?s:.)", "")
    ends = _inside(pc.count_substring(plain, '"'), begins_inside)
    opened = pc.if_else(pa.array(np.concatenate([[begins_inside], ends[:-1]])[: len(ends)]), '"', "")
    whole = pc.binary_join_element_wise(opened, plain, "")
    return ends, pc.replace_substring_regex(whole, r'"[^"]*("|\z)', "")


def _objects_look(pieces: pa.Array, begins_inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pieces between closing braces; the brace behind a piece closes an object unless it is in a string."""
    ends, bare = _json_bare(pieces, begins_inside)
    return ends, pc.count_substring(bare, "{").to_numpy(zero_copy_only=False).astype(np.int64) - ~ends


def _cells_look(pieces: pa.Array, begins_inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pieces between commas."""
    ends, bare = _json_bare(pieces, begins_inside)
    count = lambda sign: pc.count_substring(bare, sign).to_numpy(zero_copy_only=False).astype(np.int64)
    return ends, count("{") + count("[") - count("}") - count("]")


CSV = Shape("\n", _csv_look)
#: Objects of a JSON array, or one after the other.
OBJECTS = Shape("}", _objects_look, exact=True, closed=True)
#: Cells of ``{column: {index: value, …}, …}``.
CELLS = Shape(",", _cells_look, floor=2)

_PLACE = ["file", "block"]
_SUMS = "file string, block bigint, out_inside boolean, out_depth bigint, out_least bigint, in_inside boolean, in_depth bigint, in_least bigint"
_STATES = "file string, block bigint, inside boolean, depth bigint, opened bigint"
_NO_END = 1 << 60


def _pieces(spark: SparkSession, path: str | list[str], shape: Shape) -> DataFrame:
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.option("lineSep", shape.separator).text(path).select(*place, F.col("value").alias("piece"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Batches cut where the range changes, each with whether it begins a range."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column("file"), batch.column("block").to_numpy()
        codes = pc.dictionary_encode(file).indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(codes) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            place = file[a].as_py(), int(block[a])
            yield place != last, batch.slice(a, b - a)
            last = place


def _summed(shape: Shape):
    def run(batches):
        def closed():
            return pa.RecordBatch.from_pylist([state], schema=schema)

        schema = pa.schema([
            ("file", pa.string()), ("block", pa.int64()), ("out_inside", pa.bool_()), ("out_depth", pa.int64()), ("out_least", pa.int64()),
            ("in_inside", pa.bool_()), ("in_depth", pa.int64()), ("in_least", pa.int64()),
        ])
        state = None
        for begins, batch in _by_range(batches):
            if begins:
                if state:
                    yield closed()
                state = {"file": batch.column("file")[0].as_py(), "block": batch.column("block")[0].as_py()}
                for name, inside in (("out", False), ("in", True)):
                    state |= {f"{name}_inside": inside, f"{name}_depth": 0, f"{name}_least": _NO_END}
            for name in ("out", "in"):
                ends, change = shape.look(batch.column("piece"), state[f"{name}_inside"])
                depth = state[f"{name}_depth"] + np.cumsum(change)
                outside = depth[~ends]
                state[f"{name}_inside"], state[f"{name}_depth"] = bool(ends[-1]), int(depth[-1])
                state[f"{name}_least"] = min(state[f"{name}_least"], int(outside.min()) if len(outside) else _NO_END)
        if state:
            yield closed()

    return run


def _folded(shape: Shape):
    """The state at the begin of each range of a file: in a string, depth, and the range in which the open record began."""

    def run(sums: pa.Table) -> pa.Table:
        inside, depth, opened, out = False, 0, None, []
        for s in sums.sort_by("block").to_pylist():
            out.append({"file": s["file"], "block": s["block"], "inside": inside, "depth": depth, "opened": s["block"] if opened is None else opened})
            name = "in" if inside else "out"
            ends_one = depth + s[f"{name}_least"] <= shape.floor
            inside, depth = s[f"{name}_inside"], depth + s[f"{name}_depth"]
            if not inside and (depth == shape.floor if shape.exact else depth <= shape.floor):
                opened = None
            elif ends_one or opened is None:
                opened = s["block"]
        return pa.Table.from_pylist(out, schema=pa.schema([
            ("file", pa.string()), ("block", pa.int64()), ("inside", pa.bool_()), ("depth", pa.int64()), ("opened", pa.int64()),
        ]))

    return run


_PARTS = "file string, opened bigint, block bigint, number bigint, whole boolean, depth bigint, left bigint, record string"


def _cut(shape: Shape):
    """Records of each range in order, with the depth where each begins and ends; what is cut by a border is a part."""
    schema = pa.schema([
        ("file", pa.string()), ("opened", pa.int64()), ("block", pa.int64()), ("number", pa.int64()), ("whole", pa.bool_()),
        ("depth", pa.int64()), ("left", pa.int64()), ("record", pa.string()),
    ])
    between = "" if shape.closed else shape.separator

    def at_end(ends: np.ndarray, depths: np.ndarray) -> np.ndarray:
        return np.flatnonzero(~ends & ((depths == shape.floor) if shape.exact else (depths <= shape.floor)))

    def run(batches):
        def rows(opened: list, whole: list, begin: list, left: list, texts: pa.Array):
            n = len(texts)
            columns = [[place[0]] * n, opened, [place[1]] * n, range(number, number + n), whole, begin, left, texts]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        def rest():
            if held is not None:
                yield rows([opened], [False], [begun], [None], [held])

        place = held = None
        for begins, batch in _by_range(batches):
            if begins:
                yield from rest()
                place = batch.column("file")[0].as_py(), batch.column("block")[0].as_py()
                inside, depth, opened = (batch.column(c)[0].as_py() for c in ("inside", "depth", "opened"))
                held, number, begun, headless = None, 0, depth, opened != place[1]
            pieces = batch.column("piece")
            ends, change = shape.look(pieces, inside)
            depths = depth + np.cumsum(change)
            done = at_end(ends, depths)
            inside, depth, n = bool(ends[-1]), int(depths[-1]), len(done)
            bounds = [0, *(done + 1).tolist()]
            if bounds[-1] < len(pieces):
                bounds.append(len(pieces))
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pieces), shape.separator)
            if shape.closed:
                texts = pc.binary_join_element_wise(texts, shape.separator, "")
            if held is not None:
                texts = pa.concat_arrays([pa.array([held + between + texts[0].as_py()]), texts[1:]])
            if n:
                left = depths[done].tolist()
                yield rows([opened] + [place[1]] * (n - 1), [not headless] + [True] * (n - 1), [begun, *left[:-1]], left, texts[:n])
                headless, opened, begun, number = False, place[1], left[-1], number + n
            held = texts[n].as_py() if len(texts) > n else None
        yield from rest()

    return run


def _states(pieces: DataFrame, shape: Shape) -> DataFrame:
    sums = pieces.mapInArrow(_summed(shape), _SUMS)
    return sums.groupBy("file").applyInArrow(_folded(shape), _STATES)


def _parts(pieces: DataFrame, states: DataFrame, shape: Shape) -> DataFrame:
    return pieces.join(F.broadcast(states), _PLACE).mapInArrow(_cut(shape), _PARTS)


def _mended(parts: DataFrame, shape: Shape) -> DataFrame:
    """Records put together from their parts; they belong to the range where they begin."""
    listed = F.array_sort(F.collect_list(F.struct("block", "number", "depth", "left", "record")))
    first, last = F.col("parts")[0], F.element_at("parts", -1)
    text = F.array_join(F.transform("parts", lambda p: p["record"]), "" if shape.closed else shape.separator)
    grouped = parts.where("NOT whole").groupBy("file", "opened").agg(listed.alias("parts"))
    return grouped.select("file", *[first[c].alias(c) for c in ("block", "number", "depth")], last["left"].alias("left"), text.alias("record"))


_RECORD = ["file", "block", "number", "depth", "left", "record"]


def records(spark: SparkSession, path: str | list[str], shape: Shape) -> DataFrame:
    """(file, block, number, depth, left, record): range, number in it, depth where the record begins and ends, text.

    The states joined to the pieces are one row per range of the files. An unfinished record at the end
    of a file comes out as far as it goes, with ``left`` null.
    """
    pieces = _pieces(spark, path, shape)
    parts = _parts(pieces, _states(pieces, shape), shape)
    return parts.where("whole").select(_RECORD).unionByName(_mended(parts, shape))


def json_objects(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """Objects of files that hold one JSON array each, pretty-printed or on one line."""
    bare = F.regexp_replace("record", r"^[^{]*", "")
    rows = records(spark, path, OBJECTS).where(F.contains("record", F.lit("{"))).select(F.from_json(bare, schema).alias("r"))
    return rows.select("r.*")


_CSV_OPTIONS = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _csv_names(spark: SparkSession, record: str) -> list[str]:
    width = record.count(",") + 1
    cells = F.from_csv("record", ", ".join(f"_{i} string" for i in range(width)), _CSV_OPTIONS)
    found = spark.createDataFrame([(record.rstrip("\r"),)], "record string").select(cells.alias("r")).first()["r"]
    return [name for name in found if name is not None]


def csv_records(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None) -> DataFrame:
    """CSV files with a header each, quoted line breaks and doubled quotes; text columns unless a schema is given.

    Without a schema the header of the first file names the columns, which takes a look at that record.
    """
    found = records(spark, path, CSV)
    header = (F.col("block") == 0) & (F.col("number") == 0)
    if schema is None:
        first = found.where(header).orderBy("file").select("record").first()
        names = _csv_names(spark, first["record"]) if first else []
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        if not names:
            return spark.createDataFrame([], schema)
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    bare = F.regexp_replace("record", r"\r\z", "")
    rows = found.where(~header & (bare != "")).select(F.from_csv(bare, ddl, _CSV_OPTIONS).alias("r"))
    return rows.select("r.*")


_KEY = r'"((?:[^"\\]|\\.)*)"\s*:\s*'
_FILLED = "file string, block bigint, number bigint, column string, cell string"


def _named_cells(cells: DataFrame) -> DataFrame:
    """The column that a cell opens, or null, and the cell without it and without the braces behind it."""
    opening = r"^\s*\{?\s*" + _KEY + r"\{\s*"
    opens = F.col("depth") < 2
    bare = F.when(opens, F.regexp_replace("record", opening, "")).otherwise(F.col("record"))
    closed = F.when(F.col("left") == 0, F.regexp_replace(bare, r"\s*\}\s*\}\s*\z", "")).when(
        F.col("left") == 1, F.regexp_replace(bare, r"\s*\}\s*\z", "")
    )
    return cells.select(
        "file", "block", "number",
        F.when(opens, F.regexp_extract("record", opening, 1)).alias("column"), F.coalesce(closed, bare).alias("cell"),
    )


def _filled(batches):
    """Columns filled forward within a range; null before its first."""
    last = None
    for begins, batch in _by_range(batches):
        names = batch.column("column")
        if begins:
            last = None
        if names[0].as_py() is None:
            names = pa.concat_arrays([pa.array([last], pa.string()), names[1:]])
        names = pc.fill_null_forward(names)
        last = names[-1].as_py()
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], names, batch.column("cell")], names=batch.schema.names)


def columnar_cells(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(doc, column, idx, value) of files of column-oriented JSON, ``{column: {"0": v, …}, …}``.

    Cells are cut at commas. A column's name stands before its first cell only; it is filled forward
    inside a range, and over borders by a table of one row per range.
    """
    pieces = _pieces(spark, path, CELLS)
    states = _states(pieces, CELLS)
    parts = _parts(pieces, states, CELLS)
    whole, mended = _named_cells(parts.where("whole")), _named_cells(_mended(parts, CELLS))
    last = (
        whole.unionByName(mended).where("column IS NOT NULL").groupBy(_PLACE).agg(F.max_by("column", "number").alias("own"))
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = states.select(_PLACE).join(last, _PLACE, "left").withColumn("carried", F.last("own", ignorenulls=True).over(before))
    filled = whole.mapInArrow(_filled, _FILLED)
    # A record that runs over the end of its range is the last to begin there.
    every = filled.withColumn("at_end", F.lit(False)).unionByName(mended.withColumn("at_end", F.lit(True)))
    column = F.coalesce("column", F.when(F.col("at_end"), F.col("own")), "carried")
    value = F.regexp_replace("cell", r"^\s*" + _KEY, "")
    unquoted = lambda *text: F.from_json(F.concat(F.lit('{"v":'), *text, F.lit("}")), "v string")["v"]
    sign, key = F.lit('"'), F.regexp_extract("cell", r"^\s*" + _KEY, 1)
    return every.join(F.broadcast(ranges), _PLACE).where(F.col("cell").rlike(r"^\s*" + _KEY)).select(
        F.col("file").alias("doc"), unquoted(sign, column, sign).alias("column"), unquoted(sign, key, sign).alias("idx"), unquoted(value).alias("value")
    )
