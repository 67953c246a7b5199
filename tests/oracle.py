"""Compare registered queries with their SQL on the shared tables: ``python -m tests.oracle NAME …``."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    return repr(value)


def rows_of(frame_rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_cell(r[i]) for i in order) for r in frame_rows])


def difference(df, db, sql: str) -> str | None:
    """None when both sides agree, else a short account."""
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(result.fetchall(), names)
    have = rows_of([tuple(r) for r in df.collect()], df.columns)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if have == want:
        kinds = {d[0]: str(d[1]) for d in result.description}
        types = {f.name: f.dataType.simpleString() for f in df.schema}
        loose = [n for n in names if not _same_kind(types[n], kinds[n])]
        return f"types {[(n, types[n], kinds[n]) for n in loose]}" if loose else None
    odd_have, odd_want = [r for r in have if r not in set(want)][:3], [r for r in want if r not in set(have)][:3]
    return f"{len(have)} rows != {len(want)} rows or values\n  spark {str(odd_have)[:1500]}\n  sql   {str(odd_want)[:1500]}"


def _same_kind(spark_type: str, sql_type: str) -> bool:
    sql_type = sql_type.upper()
    pairs = {
        "bigint": ("BIGINT", "NUMBER"), "int": ("INTEGER", "NUMBER"), "smallint": ("SMALLINT", "NUMBER"),
        "double": ("DOUBLE", "NUMBER"), "string": ("VARCHAR", "STRING"), "boolean": ("BOOLEAN", "BOOL"),
    }
    return sql_type in pairs.get(spark_type, (sql_type,))


def main(names: list[str], sf_dir: str = "/root/testdata/sf0.01") -> int:
    from pairforge.bindings import ORACLES, QUERIES, load_all
    from pairforge.session import build_session

    load_all()
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    db, bad = connect(sf_dir), 0
    picked = [q for q in QUERIES if not names or any(q.startswith(n) for n in names)]
    for name in picked:
        began = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                told = difference(df, db, ORACLES[name]) or "ok"
            else:
                told = f"ok ({df.count()} rows, no SQL)"
        except Exception as error:
            told = f"{type(error).__name__}: {str(error)[:1500]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += not told.startswith("ok")
        print(f"{name}: {told} [{time.time() - began:.1f}s]", flush=True)
    print(f"{len(picked)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main([a for a in sys.argv[1:] if a != "-v"])))
