"""Run registered queries next to their SQL and print the differences.

Usage: python tests/check_queries.py <folder> [name ...]
"""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]

    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if hasattr(v, "tolist") and not isinstance(v, (int, float, bool)):
            v = v.tolist()
        if isinstance(v, (pd.Timestamp,)):
            return str(v)
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return repr(v)
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in pdf.itertuples(index=False, name=None))


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in got.columns}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1]}
    a, b = canonical(got), canonical(want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g.\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    return f"type kinds differ: {odd}" if odd else ""


def main() -> None:
    from zonecast.session import build_session

    import __spark_entry__ as entry

    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = fn(spark, folder).toPandas()
            took = time.time() - start
            if name in oracles:
                began = time.time()
                problem = compare(got, con.execute(oracles[name]).df())
                note = f"{time.time() - began:.1f}s sql"
            else:
                problem, note = ("" if len(got) else "no rows"), "rows only"
        except Exception as error:  # noqa: BLE001
            took, note = time.time() - start, ""
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {took:.1f}s {note} {len(got) if not problem else ''} {problem}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
