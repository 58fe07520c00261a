"""Run registered queries next to their SQL and compare: ``python -m tests.oracle [--sf 0.01] [name ...]``."""

from __future__ import annotations

import argparse
import os
import time
import traceback

import duckdb
import pandas as pd

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of comparable texts, columns by name."""
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False, name=None):
        out = []
        for v in row:
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
                out.append("~null")
            elif isinstance(v, bool) or type(v).__name__ == "bool_":
                out.append(str(bool(v)))
            elif hasattr(v, "isoformat"):
                out.append(pd.Timestamp(v).isoformat())
            elif isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
                out.append(str([str(x) for x in v]))
            elif isinstance(v, str):
                out.append(v)
            else:
                f = float(v)
                out.append(repr(int(f)) if f == int(f) and abs(f) < 1e15 else repr(f))
        rows.append(tuple(out))
    return sorted(rows)


def kind(dtype) -> str:
    name = str(dtype)
    return "number" if name.startswith(("int", "Int", "float")) else name


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = plain(got), plain(want)
    if a != b:
        odd = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return f"values differ in {sum(x != y for x, y in zip(a, b))} of {len(a)} rows: {odd}"
    for c in got.columns:
        if len(got) and str(got[c].dtype) != str(want[c].dtype) and got[c].notna().all():
            g, w = str(got[c].dtype), str(want[c].dtype)
            if {g[:5], w[:5]} != {"datet"} and g not in ("object", "str") and w not in ("object", "str"):
                return f"TYPE {c}: {g} != {w}"
    return None


def main() -> None:
    from tabulon.plans.catalog import ORACLES, QUERIES
    from tabulon.session import local_session

    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="0.01")
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    folder = f"/root/testdata/sf{a.sf}"
    spark, con = local_session(), duck(folder)
    names = [n for n in QUERIES if not a.names or any(n == x or n.startswith(x) for x in a.names)]
    bad = 0
    for n in names:
        start = time.time()
        try:
            got = QUERIES[n](spark, folder).toPandas()
            took = time.time() - start
            if n in ORACLES:
                start = time.time()
                want = con.execute(ORACLES[n]).df()
                note = compare(got, want)
                print(f"{'ok  ' if note is None else 'BAD '} {n} rows={len(got)} {took:.1f}s sql={time.time() - start:.1f}s {'' if note is None else note[:700]}", flush=True)
                bad += note is not None
            else:
                print(f"rows {n} rows={len(got)} {took:.1f}s", flush=True)
        except Exception as e:
            bad += 1
            text = str(e).split("\n")
            where = [x for x in traceback.format_exc().split("\n") if "tabulon" in x][-2:]
            print(f"FAIL {n} {type(e).__name__}: {text[0][:400]} {where}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
