"""Runs queries against their oracles: python tests/compare.py SF_DIR [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 6) + 0.0
    if isinstance(value, (bool, int, str)) or value is None:
        return value
    return str(value) if not hasattr(value, "quantize") else round(float(value), 6)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, con, name, query, sql, sf_dir) -> str | None:
    """None if both sides agree, else the difference."""
    frame = query(spark, sf_dir)
    ours = rows_of(frame.columns, frame.collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = duck(sf_dir), entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        if name not in sql:
            rows = len(query(spark, sf_dir).collect())
            print(f"rows-only {name} ({rows} rows, {time.time() - start:.1f}s)", flush=True)
            continue
        try:
            problem = compare(spark, con, name, query, sql[name], sf_dir)
        except Exception as error:  # the other queries still run
            problem = f"{type(error).__name__}: {str(error)[:300]}"
        failed += problem is not None
        print(f"{'DIFF' if problem else 'ok'} {name} ({time.time() - start:.1f}s) {problem or ''}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
