"""Compare registered queries with their SQL in DuckDB. Usage: python tests/oracle.py [sf_dir] [name part ...]"""

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def differences(df, con, sql: str) -> list[str]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    order = sorted(names)
    want = Counter(tuple(normal(row[names.index(c)]) for c in order) for row in cursor.fetchall())
    have = Counter(tuple(normal(row[c]) for c in order) for row in df.collect())
    if want == have:
        return [] if want else ["(empty)"]
    return [f"rows {sum(have.values())} != {sum(want.values())}" if sum(have.values()) != sum(want.values()) else "values",
            f"only spark {list((have - want).items())[:2]}", f"only sql {list((want - have).items())[:2]}"]


if __name__ == "__main__":
    from pyspark.sql import SparkSession
    import __spark_entry__ as entry
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(folder), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if wanted and not any(part in name for part in wanted):
            continue
        started = time.time()
        try:
            df = run(spark, folder)
            found = differences(df, con, oracles[name]) if name in oracles else [f"no SQL, {df.count()} rows"]
        except Exception as problem:
            found = [f"ERROR {type(problem).__name__} {str(problem)[:600]}"]
        bad += bool(found)
        print(f"{name:34} {time.time() - started:6.2f}s {'ok' if not found else found}", flush=True)
    print("not ok:", bad)
