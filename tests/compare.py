"""Run a registered query in Spark and its SQL in DuckDB and compare all rows."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return 0.0 if v == 0 else v
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def table_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, query, check, sf_dir):
    """Return (ok, message, seconds)."""
    start = time.time()
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if check is None:
        return True, f"rows only: {len(rows)}", took
    cursor = con.execute(check)
    sql_cols = [d[0] for d in cursor.description]
    cols_a, a = table_rows(df.columns, rows)
    cols_b, b = table_rows(sql_cols, cursor.fetchall())
    if cols_a != cols_b:
        return False, f"columns differ: {cols_a} / {cols_b}", took
    if a == b:
        types = {c: t for c, t in zip(sql_cols, [str(d[1]) for d in cursor.description])}
        odd = [f"{c}:{t}" for c, t in types.items() if "HUGE" in t or "DECIMAL" in t.upper()]
        return not odd, f"equal: {len(a)}" + (f" odd types {odd}" if odd else ""), took
    only_a = [r for r in a if r not in set(b)][:3] if len(a) < 200000 else []
    only_b = [r for r in b if r not in set(a)][:3] if len(b) < 200000 else []
    return False, f"rows differ {len(a)} / {len(b)}\n  spark {only_a}\n  sql   {only_b}".replace("\n", "\n    ")[:1500], took


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tickerloom-compare-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    wanted = sys.argv[1:]
    queries, checks = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, message, took = compare(spark, con, name, query, checks.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, message, took = False, f"{type(e).__name__}: {str(e)[:900]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {took:6.2f}s {message}", flush=True)
    print("failures:", bad)
