"""Run registered queries next to their SQL twins in DuckDB and compare every value.

    python tests/oracle_compare.py [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    cols = sorted(spark_df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in spark_df.collect()), key=repr)
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return False, f"columns {cols} vs {sorted(rel.columns)}"
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    kinds = {c: t for c, t in spark_df.dtypes}
    duck_kinds = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    odd = [f"{c}:{kinds[c]}/{duck_kinds[c]}" for c in cols if kinds[c] in same and same[kinds[c]] != duck_kinds[c]]
    note = f"  [types {odd}]" if odd else ""
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}{note}\n  spark {got[:2]}\n  duck  {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ {cols}{note}\n  spark {bad[0][0]}\n  duck  {bad[0][1]}"
    return not odd, f"{len(got)} rows{note}"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--new", action="store_true", help="only the last catalog modules")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from __spark_entry__ import oracle_sql, queries

    from tidegrid import build_session

    spark = build_session("local[3]", 4)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = duck(sf_dir)
    oracles = oracle_sql()
    failed = 0
    for name, run in queries().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        t0 = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                t1 = time.time()
                ok, note = compare(df, con, oracles[name])
                note += f"  ({t1 - t0:.1f}s build, {time.time() - t1:.1f}s both)"
            else:
                ok, note = True, f"{len(df.collect())} rows, no SQL twin ({time.time() - t0:.1f}s)"
        except Exception as err:  # report and go on
            ok, note = False, f"{type(err).__name__}: {str(err)[:600]}"
        failed += not ok
        print(("ok   " if ok else "FAIL ") + name + ": " + note, flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
