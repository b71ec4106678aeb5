"""Compare every registered query with its SQL twin: ``python tests/check_oracle.py [names…]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

import __spark_entry__ as entry
from tidemark.session import scratch_scope

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(rows: list[tuple]) -> list[tuple]:
    def cell(v):
        if isinstance(v, float):
            return ("f", "nan" if v != v else repr(v + 0.0))
        return (type(v).__name__, str(v))

    return sorted(tuple(cell(v) for v in r) for r in rows)


def compare(spark, con, name: str, folder: str) -> tuple[bool, str]:
    start = time.time()
    with scratch_scope(spark):
        df = entry.queries()[name](spark, folder)
        cols = sorted(df.columns)
        got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    took = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got) > 0, f"{len(got)} rows, no oracle, {took:.2f}s"
    start = time.time()
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return False, f"columns {cols} vs {sorted(rel.columns)}"
    types = dict(zip(rel.columns, map(str, rel.types)))
    spark_types = dict(df.dtypes)
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
            "boolean": "BOOLEAN", "date": "DATE"}
    odd = [(c, spark_types[c], types[c]) for c in cols if same.get(spark_types[c]) != types[c]]
    want = rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()
    sql_took = time.time() - start
    if odd:
        return False, f"types differ: {odd}"
    a, b = canonical(got), canonical(want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"rows {len(a)} vs {len(b)}; first differences {diff}; cols {cols}"
    return True, f"{len(a)} rows equal, spark {took:.2f}s, sql {sql_took:.2f}s"


def main() -> None:
    from pyspark.sql import SparkSession

    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    names = sys.argv[1:] or list(entry.queries())
    bad = 0
    for name in names:
        try:
            ok, text = compare(spark, con, name, folder)
        except Exception as exc:  # noqa: BLE001 - report and go on
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, text, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    spark.stop()
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
