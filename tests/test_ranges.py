"""Files whose records run over lines, read in byte ranges of any size."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from pairforge.sources import ranges, readers, writers

SIGNS = ['"', "\\", "{", "}", "[", "]", ",", ":", "\n", "\r\n", " ", "a", "é", "漢", '\\"', '""', "}{", '","', '": {"']


@pytest.fixture()
def cut(spark):
    """Cuts files every so many bytes."""

    def to(size):
        for name, value in (("maxPartitionBytes", size), ("openCostInBytes", 0)):
            spark.conf.set(f"spark.sql.files.{name}", str(value))

    yield to
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")


def words(draw):
    return "".join(draw.choices(SIGNS, k=draw.randrange(12)))


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", [200, 3000, 10**6])
def test_one_array_in_many_ranges(spark, cut, tmp_path, size, indent):
    draw = random.Random(size)
    rows = [{"query": words(draw), "metadata": [{"description": words(draw), "context": words(draw)} for _ in range(draw.randrange(3))]} for _ in range(30)]
    (tmp_path / "one.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=bool(size % 3)))
    (tmp_path / "none.json").write_text("[]")
    cut(size)
    frame = readers.json_records(spark, str(tmp_path), readers.RAW_QUERY)
    got = [r.asDict(recursive=True) for r in frame.collect()]
    order = lambda r: json.dumps(r, sort_keys=True)
    assert sorted(got, key=order) == sorted(rows, key=order)
    if size == 200:
        assert ranges._pieces(spark, str(tmp_path), ranges.OBJECTS).rdd.getNumPartitions() > 10


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [40, 300, 10**6])
def test_csv_in_many_ranges(spark, cut, tmp_path, size, ending):
    draw = random.Random(size)
    quoted = lambda t: '"' + t.replace('"', '""') + '"'
    rows = [(str(i), words(draw) or "x", draw.choice(["plain", "a\n\nb", "", " c "])) for i in range(40)]
    lines = [f"{i},{quoted(a)},{quoted(b) if chr(10) in b else b}" for i, a, b in rows]
    (tmp_path / "t.csv").write_bytes((ending.join(['id,"a name",b', *lines]) + ending * (size % 2)).encode())
    cut(size)
    frame = readers.csv_table(spark, str(tmp_path))
    assert frame.columns == ["id", "a name", "b"]
    got = {r["id"]: (r["a name"], r["b"]) for r in frame.collect()}
    assert got == {i: (a, b or None) for i, a, b in rows}
    typed = readers.csv_table(spark, str(tmp_path), "id bigint, a string, b string")
    assert typed.agg(F.sum("id")).first()[0] == sum(range(40))


@pytest.mark.parametrize("size", [60, 10**6])
@pytest.mark.parametrize("indent", [None, 1])
def test_columns_in_many_ranges(spark, cut, tmp_path, size, indent):
    draw = random.Random(size)
    names = ["query", 'odd "name", {x', "context"]
    data = {c: {str(i): draw.choice([words(draw), i, None, {"k": [1, {"z": words(draw)}]}, True]) for i in range(40) if draw.random() < 0.8} for c in names}
    (tmp_path / "c.json").write_text(json.dumps(data, indent=indent))
    cut(size)
    got = {(r["column"], r["idx"]): r["value"] for r in ranges.columnar_cells(spark, str(tmp_path)).collect()}
    want = {(c, i): v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":")) for c, cells in data.items() for i, v in cells.items()}
    plain = {k: json.dumps(json.loads(v), separators=(",", ":")) if isinstance(data[k[0]][k[1]], dict) else v for k, v in got.items()}
    plain_want = {k: json.dumps(json.loads(v), separators=(",", ":")) if isinstance(data[k[0]][k[1]], dict) else v for k, v in want.items()}
    assert plain == plain_want
    rows = readers.columnar_json(spark, str(tmp_path), names).collect()
    assert len(rows) == len({i for c in data.values() for i in c})


def test_sinks_write_files_others_can_read(spark, tmp_path):
    frame = spark.range(50, numPartitions=3).selectExpr("id", "concat('a\"\n', id) AS text", "if(id % 7 = 0, null, id * 1.5) AS x")
    writers.write_json_arrays(frame.where("id < 40"), str(tmp_path / "arrays"))
    writers.write_columnar_json(frame, str(tmp_path / "columns"), "id")
    arrays = [json.loads((tmp_path / "arrays" / f).read_text()) for f in os.listdir(tmp_path / "arrays") if f.startswith("part")]
    assert sorted(r["id"] for a in arrays for r in a) == list(range(40)) and len(arrays) == 3
    columns = [json.loads((tmp_path / "columns" / f).read_text()) for f in os.listdir(tmp_path / "columns") if f.startswith("part")]
    assert {k: v for c in columns for k, v in c["text"].items()} == {str(i): f'a"\n{i}' for i in range(50)}
    assert readers.columnar_json(spark, str(tmp_path / "columns"), ["text", "x"]).where("x IS NULL").count() == 8


def test_a_file_without_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("")
    assert readers.csv_table(spark, str(tmp_path / "t.csv")).count() == 0
    (tmp_path / "c.json").write_text("{}")
    assert readers.columnar_json(spark, str(tmp_path / "c.json"), ["a"]).count() == 0


def test_no_file_is_larger_than_its_bytes(spark, tmp_path):
    draw = random.Random(4)
    names = ["sparql_raw", "sparql_annotated", "sparql_query", "complexity", "complexity_description", "query_results"]
    rows = [(i, ["x"] * draw.randrange(3), draw.choice(["train", "test"]), *["".join(draw.choices("abcdefghij", k=draw.choice([0, 5, 4000]))) for _ in names]) for i in range(120)]
    frame = spark.createDataFrame(rows, "id bigint, instructions array<string>, split string, " + ", ".join(f"{n} string" for n in names))
    limit = 60_000
    writers.write_dataset(frame, str(tmp_path / "d"), max_bytes_per_file=limit)
    files = [os.path.join(d, f) for d, _, found in os.walk(tmp_path / "d") for f in found if f.endswith(".parquet")]
    assert len(files) > 10 and max(map(os.path.getsize, files)) < limit
    read = readers.dataset(spark, str(tmp_path / "d"))
    assert "shard" not in read.columns and sorted((r["id"], r["split"], r["sparql_raw"]) for r in read.collect()) == sorted((r[0], r[2], r[3]) for r in rows)
    assert readers.dataset(spark, str(tmp_path / "d"), split="test").count() == sum(r[2] == "test" for r in rows)
