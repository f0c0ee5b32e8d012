"""Run registered queries and compare them with their SQL in DuckDB.

Usage: python tests/compare.py SF_DIR [name-prefix ...]
"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return int(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def check(spark, con, sf, name):
    """None when equal, else a description of the difference."""
    from loglattice.plans import QUERIES, SQL

    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name not in SQL:
        return None if got else "no rows"
    cur = con.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a == b:
        return None if a else "both empty"
    diff = next(((x, y) for x, y in zip(a, b) if x != y), None)
    return f"rows {len(a)} vs {len(b)}; first difference {diff}"[:900]


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from loglattice.plans import QUERIES, SQL

    sf, prefixes = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in QUERIES:
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            problem = check(spark, con, sf, name)
        except Exception as exc:
            problem = "ERROR " + str(exc)[:700]
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {'sql' if name in SQL else 'rows'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("bad:", bad, "of", len(QUERIES))
