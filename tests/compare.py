"""Compares queries with their SQL in DuckDB: python tests/compare.py FOLDER [QUERY...]"""

import glob
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as E


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def canonical(rows, columns):
    def cell(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(map(cell, v)) + "]"
        return "\\N" if v is None else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main(folder, names):
    spark, base = session(), duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        base.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    queries, sql, bad = E.queries(), E.oracle_sql(), []
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            got = canonical(df.collect(), df.columns)
        except Exception as e:
            print(f"{name}: FAILED {str(e)[:300]}", flush=True)
            bad.append(name)
            continue
        took = time.time() - start
        if name not in sql:
            print(f"{name}: {len(got)} rows in {took:.1f} s, no SQL", flush=True)
            continue
        start = time.time()
        try:
            result = base.execute(sql[name])
        except duckdb.Error as e:
            print(f"{name}: SQL FAILED {str(e)[:300]}", flush=True)
            bad.append(name)
            continue
        columns = [c[0] for c in result.description]
        want = canonical(result.fetchall(), columns)
        same = sorted(columns) == sorted(df.columns) and got == want
        print(f"{name}: {'same' if same else 'DIFFERENT'}, {len(got)} and {len(want)} rows in {took:.1f} and {time.time() - start:.1f} s", flush=True)
        if not same:
            bad.append(name)
            print("  columns", sorted(df.columns), sorted(columns))
            a, b = set(got), set(want)
            print("  only Spark", list(a - b)[:4], "\n  only SQL", list(b - a)[:4])
    print("different:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
