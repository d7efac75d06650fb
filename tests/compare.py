"""Run registered queries beside their SQL twin in DuckDB and compare rows. Usable as a script."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), ignore_index=True)


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """None when equal, else a short reason."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    left, right = canonical(left), canonical(right)
    for column in left.columns:
        a, b = left[column], right[column]
        if str(a.dtype) != str(b.dtype) and a.isna().any() and pd.api.types.is_numeric_dtype(a) and pd.api.types.is_numeric_dtype(b):
            a, b = a.astype("Float64"), b.astype("Float64")  # pandas has no nulls in plain integers
        if str(a.dtype) != str(b.dtype) and not (a.isna().all() and b.isna().all()):
            return f"{column}: type {a.dtype} != {b.dtype}"
        same = (a == b).fillna(False).astype(bool) | (a.isna() & b.isna())
        if not same.all():
            at = (~same).idxmax()
            return f"{column}: {(~same).sum()} differ, first {a[at]!r} != {b[at]!r}"
    return None


if __name__ == "__main__":
    from mutascale.session import build_session
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    chosen = sys.argv[2:]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="16g", spark__log__level="ERROR")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    oracles = entry.oracle_sql()
    for name, run in entry.queries().items():
        if chosen and name not in chosen:
            continue
        begin = time.time()
        try:
            result = run(spark, sf_dir).toPandas()
        except Exception as error:  # noqa: BLE001
            print(f"{name:26s} SPARK ERROR {str(error)[:600]}", flush=True)
            continue
        took = time.time() - begin
        if name not in oracles:
            print(f"{name:26s} rows only {len(result)} {took:6.1f}s", flush=True)
            continue
        begin = time.time()
        try:
            expected = connection.execute(oracles[name]).fetchdf()
        except Exception as error:  # noqa: BLE001
            print(f"{name:26s} SQL ERROR {str(error)[:600]}", flush=True)
            continue
        verdict = difference(result, expected) or "ok"
        print(f"{name:26s} {verdict} ({len(result)} rows, spark {took:.1f}s, sql {time.time() - begin:.1f}s)", flush=True)
