"""Run registered queries next to their DuckDB text: ``python -m tests.check [sf] [name-part ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canon(df: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples, columns by name; numbers compared as they are, to nine digits."""
    def cell(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0) == 1:
            return tuple(cell(x) for x in v)
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, bool):
            return v
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return round(float(v), 9) + 0.0
        if type(v).__name__ == "Decimal":
            return round(float(v), 9) + 0.0
        return str(v)

    cols = sorted(df.columns)
    return sorted((tuple(cell(v) for v in row) for row in df[cols].itertuples(index=False, name=None)),
                  key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canon(got), canon(want)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b), key=str), sorted(set(b) - set(a), key=str)
        return f"{len(only_a)} rows differ, got {only_a[:2]} want {only_b[:2]}"
    return "ok"


def main() -> None:
    from procspark.session import build
    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/{sf}"
    spark = build("local[8]")
    con = connect(sf_dir)
    bad = 0
    for name, fn in e.queries().items():
        if parts and not any(p == name or (p.endswith("*") and name.startswith(p[:-1])) for p in parts):
            continue
        t = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - t
            sql = e.oracle_sql().get(name)
            verdict = compare(got, con.execute(sql).df()) if sql else "rows only"
        except Exception as exc:  # noqa: BLE001
            took, verdict, got = time.time() - t, f"FAILED {type(exc).__name__}: {str(exc)[:600]}", []
        if verdict not in ("ok", "rows only"):
            bad += 1
        print(f"{name:34s} {took:6.2f}s {len(got):7d} rows  {verdict}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
