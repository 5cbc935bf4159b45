"""Run queries next to their SQL and report differences.

    python tests/compare.py [--sf sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return [canon(v) for v in value]
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(canon(r[i])) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return f"rows {len(got)} (no SQL) spark {t1 - t0:.1f}s", bool(got)
    cur = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    t2 = time.time()
    note = f"rows {len(got)} spark {t1 - t0:.1f}s duckdb {t2 - t1:.1f}s"
    if got_cols != want_cols:
        return f"{note} COLUMNS {got_cols} != {want_cols}", False
    if got != want:
        a, b = set(got), set(want)
        return f"{note} MISMATCH rows {len(got)}/{len(want)} only-spark {sorted(a - b)[:3]} only-sql {sorted(b - a)[:3]}", False
    return note, bool(got)


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/{args.sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name in args.names or queries:
        try:
            note, ok = compare(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as err:  # report and go on with the next query
            note, ok = f"ERROR {type(err).__name__}: {str(err)[:600]}", False
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
        bad += [] if ok else [name]
    print(f"{len(bad)} failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
