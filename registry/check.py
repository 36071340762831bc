"""Run registered queries next to their SQL form: ``python -m registry.check [dir] [names...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    out = []
    for v in row:
        if v is None:
            out.append("~")
        elif isinstance(v, float):
            out.append("0.0" if v == 0 else "nan" if math.isnan(v) else repr(v))
        else:
            out.append(str(v))
    return tuple(out)


def compare(spark, con, query, sf_dir: str):
    """(message or None, rows, seconds)."""
    start = time.time()
    df = query.run(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(_key(r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    took = time.time() - start
    if query.sql is None:
        return None, len(got), took
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = sorted(_key(r) for r in con.execute(f"SELECT {quoted} FROM ({query.oracle()})").fetchall())
    if got == want:
        return None, len(got), took
    a, b = set(got), set(want)
    only_spark, only_sql = sorted(a - b)[:2], sorted(b - a)[:2]
    diff = []
    if only_spark and only_sql:
        diff = [(c, x, y) for c, x, y in zip(cols, only_spark[0], only_sql[0]) if x != y][:6]
    return f"{len(got)} rows vs {len(want)}; {len(a - b)} / {len(b - a)} differ; {diff or (only_spark, only_sql)}", len(got), took


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    from registry.catalogue import QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = session(), connect(sf_dir)
    bad = 0
    for name in names:
        try:
            message, rows, took = compare(spark, con, QUERIES[name], sf_dir)
        except Exception as e:  # report and go on with the next query
            message, rows, took = f"{type(e).__name__}: {str(e)[:600]}", -1, 0.0
        bad += message is not None
        kind = "rows" if QUERIES[name].sql is None else "sql"
        print(f"{'FAIL' if message else 'ok  '} {name:40s} {kind:4s} {rows:8d} {took:6.2f}s {message or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(main())
