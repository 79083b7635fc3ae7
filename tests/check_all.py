"""Run all queries against DuckDB: python tests/check_all.py [data dir] [name ...]."""

import sys
import time
import traceback

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

import oracle
from pyspark.sql import SparkSession

from __spark_entry__ import oracle_sql, queries

data_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = (
    SparkSession.builder.master("local[8]")
    .config("spark.sql.shuffle.partitions", "8")
    .config("spark.ui.enabled", "false")
    .config("spark.driver.memory", "8g")
    .config("spark.sql.session.timeZone", "UTC")
    .config("spark.ui.showConsoleProgress", "false")
    .getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
con = oracle.connect(data_dir)
bad = 0
for name, build in queries().items():
    if names and name not in names:
        continue
    began = time.time()
    try:
        df = build(spark, data_dir)
        sql = oracle_sql().get(name)
        if sql is None:
            rows = df.collect()
            note = f"rows only: {len(rows)} {str(rows[:1])[:200]}"
        else:
            note = oracle.compare(df, con, sql) or "ok"
            bad += note != "ok"
    except Exception as error:
        bad += 1
        note = "ERROR " + str(error)[:600].replace("\n", " | ")
        if names:
            traceback.print_exc()
    print(f"{name:28s} {time.time() - began:6.2f}s {note}", flush=True)
print("failures:", bad)
