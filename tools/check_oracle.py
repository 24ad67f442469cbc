"""Runs registered queries in Spark and their SQL in DuckDB on the same tables and compares columns, rows and values.

    python tools/check_oracle.py [--sf DIR] [--only NAME ...] [--plan]
"""

from __future__ import annotations

import argparse
import importlib
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from sigloft.catalog.registry import ORACLES, QUERIES  # noqa: E402
from sigloft.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
MODULES = "markets news matching ingest candidates study backtests book serving retrieval tables streams".split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def normal(rows: list[tuple]) -> list[tuple]:
    def one(x):
        if x is None:
            return ""
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float)):
            return repr(float(x) + 0.0)
        return str(x)

    return sorted(tuple(one(x) for x in r) for r in rows)


def compare(spark_df, con, sql: str) -> tuple[str, int]:
    names = sorted(spark_df.columns)
    mine = normal([tuple(r) for r in spark_df.select(*names).collect()])
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    if sorted(columns) != names:
        return f"columns differ: {names} / {sorted(columns)}", len(mine)
    order = [columns.index(n) for n in names]
    theirs = normal([tuple(r[i] for i in order) for r in rel.fetchall()])
    if len(mine) != len(theirs):
        return f"rows differ: {len(mine)} / {len(theirs)}", len(mine)
    if mine != theirs:
        bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
        return f"{len(bad)} values differ, first {str(bad[0])[:600]}", len(mine)
    return "ok", len(mine)


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("--only", nargs="*")
    args.add_argument("--modules", nargs="*", default=MODULES)
    args.add_argument("--plan", action="store_true")
    opt = args.parse_args()
    for m in opt.modules:
        importlib.import_module(f"sigloft.catalog.{m}")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(opt.sf), 0
    for name, fn in QUERIES.items():
        if opt.only and name not in opt.only:
            continue
        start = time.time()
        try:
            df = fn(spark, opt.sf)
            if opt.plan:
                df.explain("formatted")
            if name in ORACLES:
                status, n = compare(df, con, ORACLES[name])
            else:
                n = len(df.collect())
                status = "rows only"
        except Exception as e:  # noqa: BLE001
            status, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        bad += status not in ("ok", "rows only")
        print(f"{name:28s} {n:8d} rows {time.time() - start:6.2f}s  {status}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
