"""Runs registered queries in Spark and their SQL in DuckDB and compares the values.

``python tests/compare.py [folder] [name ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else repr(round(float(v), 9))
    return repr(v)


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(_value(r[i]) for i in order) for r in rows])


def differences(spark_df, con, sql: str) -> str | None:
    left = normalized(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    right = normalized([c[0] for c in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} vs {right[0]}"
    if left[1] == right[1]:
        return None
    a, b = set(left[1]), set(right[1])
    one, two = sorted(a - b)[:1], sorted(b - a)[:1]
    detail = ""
    if one and two:
        detail = "\n".join(f"   {c}: {x[:300]} | {y[:300]}" for c, x, y in zip(left[0], one[0], two[0]) if x != y)
    return f"rows {len(left[1])} vs {len(right[1])}, differing {len(a - b)}/{len(b - a)}\n{detail or (one, two)}"


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.log.structuredLogging.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = args or list(queries)
    spark, con = session(), connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name not in oracle:
                print(f"--   {name}: {df.count()} rows, no SQL", flush=True)
                continue
            diff = differences(df, con, oracle[name])
        except Exception as error:  # report and go on with the next query
            diff = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'BAD '} {name} {time.time() - start:.1f}s {diff or ''}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
