"""Run registered queries next to their SQL and compare the rows.

    python tests/check_sql.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return f"{value:.9g}"
    if isinstance(value, bool):
        return str(value)
    return str(value)


def rows(df: pd.DataFrame):
    cols = sorted(df.columns)
    return cols, sorted(
        (tuple(canon(v) for v in r) for r in df[cols].itertuples(index=False, name=None)),
        key=lambda r: tuple((x is None, x or "") for x in r),
    )


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None where both hold the same rows, else what differs."""
    gc, g = rows(got)
    wc, w = rows(want)
    if gc != wc:
        return f"columns {gc} != {wc}"
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in gc}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and {*k} & set("if") and len(got)}
    if len(g) != len(w):
        return f"row count {len(g)} != {len(w)}"
    if g != w:
        diff = [(a, b) for a, b in zip(g, w) if a != b]
        return f"{len(diff)} rows differ, first {gc}\n     spark {diff[0][0]}\n     sql   {diff[0][1]}"
    return f"types {odd}" if odd else None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from marginalia.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session(
        "local[8]",
        spark_sql_shuffle_partitions="8",
        spark_marginalia_spread="8",
        spark_driver_memory="16g",
        spark_ui_enabled="false",
        spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        try:
            t = time.time()
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - t
            if name not in sqls:
                print(f"rows {name} {len(got)} rows {took:.1f}s", flush=True)
                if len(got) and len(args):
                    print(got.head(8).to_string())
                continue
            t = time.time()
            want = con.sql(sqls[name]).df()
            sql_took = time.time() - t
            problem = compare(got, want)
            note = "" if len(got) else "  EMPTY"
        except Exception as exc:
            problem, note = f"{type(exc).__name__}: {str(exc)[:1500]}", ""
            took = sql_took = 0.0
        bad += problem is not None
        state = "ok  " if problem is None else "FAIL"
        print(f"{state} {name} {len(got) if problem is None else ''} rows {took:.1f}s sql {sql_took:.1f}s{note}", flush=True)
        if problem:
            print("    ", problem, flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
