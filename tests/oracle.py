"""Runs queries and their SQL side by side: python tests/oracle.py SF_DIR [QUERY...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def canonical(rows, names) -> list[tuple]:
    """Rows with their columns by name, in an order of their own."""
    at = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else bytes(v) if isinstance(v, (bytearray, memoryview)) else v
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def same(spark, db, name: str, sf_dir: str) -> tuple[bool, str]:
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    got = canonical(df.collect(), df.columns)
    cursor = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = canonical(cursor.fetchall(), names)
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        a, b = next(((x, y) for x, y in zip(got, want) if x != y), (got[-1:], want[-1:]))
        return False, f"{len(got)} and {len(want)} rows; first difference {str(a)[:300]} and {str(b)[:300]}"
    return True, f"{len(got)} rows"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sys.argv[1])
    for name in sys.argv[2:] or entry.queries():
        began = time.time()
        try:
            if name in entry.oracle_sql():
                ok, what = same(spark, db, name, sys.argv[1])
                print(("ok  " if ok else "BAD ") + name, what, round(time.time() - began, 1), flush=True)
            else:
                print("rows", name, entry.queries()[name](spark, sys.argv[1]).count(), round(time.time() - began, 1), flush=True)
        except Exception as error:
            print("ERR ", name, str(error)[:600], flush=True)
