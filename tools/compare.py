"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

    python tools/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from checks import ORACLES, QUERIES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    return v


def row_bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> str:
    start = time.perf_counter()
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    took = time.perf_counter() - start
    if name not in ORACLES:
        return f"rows   {name:28} {len(rows):8} rows {took:6.2f}s"
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"FAIL   {name}: columns {df.columns} against {names}"
    ours, theirs = row_bag(df.columns, rows), row_bag(names, result.fetchall())
    if ours == theirs:
        return f"ok     {name:28} {len(rows):8} rows {took:6.2f}s"
    extra, missing = ours - theirs, theirs - ours
    return (
        f"FAIL   {name}: {sum(extra.values())} only here {list(extra)[:3]}, "
        f"{sum(missing.values())} only in SQL {list(missing)[:3]}"
    )


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    failed = 0
    for name in args.names or QUERIES:
        try:
            line = compare(spark, con, args.sf, name)
        except Exception as exc:  # report and go on with the next query
            line = f"FAIL   {name}: {type(exc).__name__}: {str(exc)[:600]}"
        failed += line.startswith("FAIL")
        print(line, flush=True)
    print(f"{failed} failed")
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
