"""Run registered queries on Spark and DuckDB and compare the rows.

    python tests/compare.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import math
import pathlib
import sys
import tempfile
import time

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def spark_session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("opsweave-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="opsweave-tests-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(0.0 if v == 0 else v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, plan, sql, folder):
    t = time.time()
    df = plan(spark, folder)
    got = [tuple(r) for r in df.collect()]
    secs = time.time() - t
    if sql is None:
        return "rows", f"{len(got)} rows", secs
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return "FAIL", f"columns {sorted(df.columns)} vs {sorted(cols)}", secs
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return "ok", f"{len(a)} rows", secs
    only_a = [x for x in a if x not in set(b)][:3]
    only_b = [x for x in b if x not in set(a)][:3]
    return "FAIL", f"{sorted(cols)} spark {len(a)} duck {len(b)}\n   spark: {only_a}\n   duck:  {only_b}", secs


def main(argv):
    from opsweave.plans.catalog import ORACLES, PLANS

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    prefixes = tuple(argv[1:])
    spark, con = spark_session(), duck(folder)
    bad = 0
    for name, plan in PLANS.items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            verdict, detail, secs = compare(spark, con, name, plan, ORACLES.get(name), folder)
        except Exception as exc:  # report and go on with the next query
            verdict, detail, secs = "ERROR", str(exc)[:1500], 0.0
        bad += verdict in ("FAIL", "ERROR")
        print(f"{verdict:5} {name:40} {secs:6.2f}s {detail}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
