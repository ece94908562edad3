"""Run registered queries next to their SQL: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.catalog import catalog


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _rows(columns: list[str], rows: list) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(_plain(r[i]) for i in order)) for r in rows)


def compare(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> dict[str, str]:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        view = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{path}'")
    result = {}
    for name, item in catalog().items():
        if names and name not in names:
            continue
        start = time.time()
        df = item.run(spark, sf_dir)
        got = df.collect()
        mid = time.time()
        if item.oracle is None:
            result[name] = f"rows only ({len(got)})"
        else:
            cursor = con.execute(item.oracle)
            columns = [d[0] for d in cursor.description]
            wanted = cursor.fetchall()
            mine, theirs = _rows(df.columns, got), _rows(columns, wanted)
            if sorted(columns) != sorted(df.columns):
                result[name] = f"COLUMNS {df.columns} {columns}"
            elif mine == theirs:
                result[name] = f"ok ({len(got)} rows)"
            else:
                only = sorted(set(mine) - set(theirs))[:3], sorted(set(theirs) - set(mine))[:3]
                result[name] = f"DIFFERS {len(mine)} {len(theirs)} {only}"
        end = time.time()
        print(f"{name:32s} {mid - start:6.2f}s {end - mid:6.2f}s {result[name]}", flush=True)
    return result


if __name__ == "__main__":
    from tillmark.session import local_session

    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    outcome = compare(local_session(), directory, sys.argv[2:])
    bad = [n for n, text in outcome.items() if text.startswith(("DIFFERS", "COLUMNS"))]
    print("all equal" if not bad else f"different: {bad}")
    sys.exit(bool(bad))
