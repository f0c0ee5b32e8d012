"""Compare registered queries of the llm folder with their SQL: python tests/llm/compare.py SF_DIR [prefix ...]"""

import importlib.util
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

_spec = importlib.util.spec_from_file_location("base_compare", os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "compare.py"))
_base = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_base)
connect, rows_of = _base.connect, _base.rows_of


def check(spark, con, sf, build, sql):
    df = build(spark, sf)
    got = [tuple(r) for r in df.collect()]
    if not sql:
        return None if got else "no rows"
    cur = con.execute(sql)
    columns, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a == b:
        return None if a else "both empty"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"rows {len(a)} vs {len(b)}; {len(bad)} differ; {bad[:2]}"[:900]


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from loglattice.llm import QUERIES, SQL

    sf, prefixes = sys.argv[1], tuple(sys.argv[2:]) or ("",)
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for name in QUERIES:
        if name.startswith(prefixes):
            start = time.time()
            problem = check(spark, con, sf, QUERIES[name], SQL.get(name))
            print("ok " if problem is None else "BAD", name, f"{time.time() - start:.1f}s", problem or "", flush=True)
