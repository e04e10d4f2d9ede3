"""Run registered queries on Spark and their SQL on DuckDB and compare: row counts, column names, values."""
import datetime as dt
import math
import os
import sys
import tempfile
import threading
import time

import duckdb
from pyspark.sql import SparkSession

LIMIT = float(os.environ.get("QUERY_LIMIT", "400"))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session():
    spark = (SparkSession.builder.master("local[8]").appName("tocsin-tests")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.extraJavaOptions", "-Xss16m").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int,)):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 1e15 else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v.asDict().values())
    try:
        return norm(float(v))
    except (TypeError, ValueError):
        return str(v)


def compare(spark, con, sf, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf)
    cols = sorted(df.columns)
    rows = [tuple(norm(r[c]) for c in cols) for r in df.toArrow().to_pylist()]
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(rows)}", t1 - t0, 0.0, len(rows) > 0
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    raw = res.fetchall()
    t2 = time.time()
    if sorted(dcols) != cols:
        return f"COLUMNS spark={cols} sql={sorted(dcols)}", t1 - t0, t2 - t1, False
    at = [dcols.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in at) for r in raw]
    if len(rows) != len(want):
        return f"ROWS spark={len(rows)} sql={len(want)}", t1 - t0, t2 - t1, False
    key = repr
    a, b = sorted(rows, key=key), sorted(want, key=key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"VALUES {len(bad)}/{len(a)} cols={cols}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}", t1 - t0, t2 - t1, False
    return f"ok {len(rows)}" + (" EMPTY" if not rows else ""), t1 - t0, t2 - t1, True


def main(patterns, sf):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as e
    spark, con = session(), duck(sf)
    oracle = e.oracle_sql()
    bad = 0
    for name, fn in e.queries().items():
        if patterns and not any(p in name for p in patterns):
            continue
        guard = threading.Timer(LIMIT, lambda: (spark.sparkContext.cancelAllJobs(), con.interrupt()))
        guard.start()
        try:
            msg, a, b, ok = compare(spark, con, sf, name, fn, oracle.get(name))
        except Exception as ex:  # report and go on
            msg, a, b, ok = f"ERROR {type(ex).__name__}: {str(ex)[:700]}", 0, 0, False
        guard.cancel()
        bad += not ok
        print(f"{'  ' if ok else '!!'} {name:45s} spark {a:6.2f}s duck {b:6.2f}s  {msg}", flush=True)
    print("FAILED", bad)


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("sf"):
        sf = "/root/testdata/" + args.pop(0)
    main(args, sf)
