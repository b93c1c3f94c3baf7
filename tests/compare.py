"""Run registered queries next to their DuckDB twins and compare rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((value is None, type(value).__name__ if value is not None else "", str(value)) for value in row)


def differences(spark_df, con, sql: str) -> str | None:
    """Text of the first difference, or None."""
    twin = con.sql(sql)
    names = sorted(spark_df.columns)
    if names != sorted(twin.columns):
        return f"columns {names} != {sorted(twin.columns)}"
    left = sorted((tuple(row[n] for n in names) for row in spark_df.collect()), key=_key)
    picks = [twin.columns.index(n) for n in names]
    right = sorted((tuple(row[i] for i in picks) for row in twin.fetchall()), key=_key)
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}"
    for a, b in zip(left, right):
        if _key(a) != _key(b):
            return f"columns {names}\n   spark  {a}\n   duckdb {b}"
    return None


def main() -> None:
    from kerbflow.session import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, function in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                note = differences(function(spark, folder), con, oracles[name]) or "ok"
            else:
                note = f"rows {len(function(spark, folder).collect())} (no twin)"
        except Exception as error:  # report and go on with the next query
            note = f"ERROR {type(error).__name__}: {str(error)[:900]}"
        bad += note != "ok" and "no twin" not in note
        print(f"{name:34s} {time.time() - start:6.2f}s {note}", flush=True)
    print(f"bad: {bad}")


if __name__ == "__main__":
    main()
