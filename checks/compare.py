"""Run registered queries next to their SQL counterparts and compare all values.

    python -m checks.compare [--sf /root/testdata/sf0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import time

import duckdb


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6g}" if abs(value) < 1e-3 else repr(round(value, 6))
    if isinstance(value, int):
        return repr(float(value))
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value) if not type(value).__name__ == "Decimal" else repr(round(float(value), 6))


def table(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=lambda t: tuple((v is None, str(v)) for v in t))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def compare_one(spark, con, name, function, sql, sf_dir) -> tuple[str, float, int, str]:
    started = time.time()
    df = function(spark, sf_dir)
    rows = df.collect()
    seconds = time.time() - started
    if sql is None:
        return "rows only", seconds, len(rows), ""
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    expected = found.fetchall()
    if sorted(columns) != sorted(df.columns):
        return "COLUMNS", seconds, len(rows), f"{sorted(df.columns)} != {sorted(columns)}"
    ours, theirs = table(df.columns, rows), table(columns, expected)
    if len(ours) != len(theirs):
        return "ROWS", seconds, len(rows), f"{len(ours)} != {len(theirs)}; {ours[:3]} | {theirs[:3]}"
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if different:
        return "VALUES", seconds, len(rows), f"{sorted(columns)}: {len(different)} rows, first {different[:2]}"
    return "ok", seconds, len(rows), ""


def main():
    from tablewright.session import build_session

    from . import REGISTRY

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session(
        "compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    bad = 0
    for name, (function, sql) in REGISTRY.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            status, seconds, n, note = compare_one(spark, con, name, function, sql, args.sf)
        except Exception as problem:  # noqa: BLE001
            status, seconds, n, note = "ERROR", 0.0, 0, str(problem)[:600]
        bad += status not in ("ok", "rows only")
        print(f"@@ {status:10s} {seconds:6.1f}s {n:7d} {name} {note}", flush=True)
    print(f"@@ {bad} failed", flush=True)


if __name__ == "__main__":
    main()
