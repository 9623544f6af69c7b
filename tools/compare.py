"""Run registered queries on Spark and their SQL twins on DuckDB, and compare the rows.

usage: python tools/compare.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v: object) -> object:
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.12g}") + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def rows_of(columns: list[str], rows: list) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name: str, sf: str) -> tuple[bool, str]:  # noqa: ANN001
    from ledgerveil.catalog import ORACLES, QUERIES

    df = QUERIES[name](spark, sf)
    got_cols, got = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        return True, f"rows only, {len(got)} rows"
    rel = con.sql(ORACLES[name])
    want_cols, want = rows_of(rel.columns, rel.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}; spark {got[:2]} duck {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, first: spark {bad[0][0]} duck {bad[0][1]}"
    types = [f"{c}:{s}/{d}" for c, s, d in zip(df.columns, [t for _, t in df.dtypes], [_type(rel, c) for c in df.columns]) if not _same(s, d)]
    return True, f"{len(got)} rows" + (f"  TYPES {types}" if types else "") + ("  EMPTY" if not got else "")


def _type(rel, c: str) -> str:  # noqa: ANN001
    return str(rel.types[rel.columns.index(c)])


_MAP = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
}


def _same(s: str, d: str) -> bool:
    return _MAP.get(s, s).upper() == d.upper()


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--time", action="store_true")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from ledgerveil.catalog import QUERIES
    from ledgerveil.session import build_session

    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(a.sf)
    failed = []
    for name in QUERIES:
        if a.names and not any(name.startswith(n) for n in a.names):
            continue
        t = time.time()
        try:
            ok, note = compare(spark, con, name, a.sf)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - t:6.1f}s  {note[:900]}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
