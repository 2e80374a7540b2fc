"""Run queries beside their SQL: python tests/oracle_check.py [sf] [name …]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows), sorted(columns)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, query, sql, sf_dir):
    """(verdict, rows, seconds, detail) of one query."""
    start = time.time()
    df = query(spark, sf_dir)
    got, got_columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - start
    if sql is None:
        return "rows", len(got), seconds, ""
    result = con.sql(sql)
    want, want_columns = rows_of(result.columns, result.fetchall())
    if got_columns != want_columns:
        return "COLUMNS", len(got), seconds, f"{got_columns} != {want_columns}"
    if got == want:
        return "ok", len(got), seconds, ""
    left, right = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
    return "DIFF", len(got), seconds, f"{len(got)} vs {len(want)}\n  spark {left}\n  sql   {right}"


def main():
    import __spark_entry__ as entry

    from leadlake.session import get_session

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    spark = get_session(master="local[6]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con, queries, oracles = duck(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args[1:] or queries:
        try:
            verdict, n, seconds, detail = compare(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as error:  # report every failure, then go on
            verdict, n, seconds, detail = "ERROR", 0, 0.0, str(error)[:600]
        bad += verdict not in ("ok", "rows")
        print(f"{verdict:8}{name:28}{n:8}{seconds:7.2f}s {detail}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
