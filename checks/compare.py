"""Run registered queries against their oracle.

``python -m checks.compare [sf_dir] [name ...] [spark.setting=value ...]``
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle_connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def normalized(df: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples over the columns in name order; missing values as one marker."""
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
            return "<null>"
        if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return repr(float(v))
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False))


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, else a short description."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = normalized(got), normalized(want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, columns {sorted(got.columns)}; first {bad[0]}"
    return None


def main(argv: list[str]) -> int:
    from checks.catalog import ENTRIES
    from ledgerlens.session import build_session

    settings = dict(a.split("=", 1) for a in argv if "=" in a)
    argv = [a for a in argv if "=" not in a]
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(ENTRIES)
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false", **settings})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf)
    failures = 0
    for name in names:
        entry = ENTRIES[name]
        start = time.time()
        try:
            got = entry.run(spark, sf).toPandas()
            took = time.time() - start
            if entry.sql is None:
                print(f"rows  {name:32s} {len(got):7d} rows {took:6.2f}s", flush=True)
                continue
            problem = difference(got, con.execute(entry.sql).df())
        except Exception as error:  # report every query, not only the first failure
            problem, took = f"{type(error).__name__}: {str(error)[:600]}", time.time() - start
        failures += problem is not None
        state = "ok   " if problem is None else "FAIL "
        print(f"{state} {name:32s} {'' if problem else str(len(got)).rjust(7) + ' rows'} {took:6.2f}s {problem or ''}", flush=True)
    print(f"{len(names)} queries, {failures} failures")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
