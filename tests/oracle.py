"""Runs queries and their SQL side by side: python tests/oracle.py [sf_dir] [names...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def difference(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty if the query and the SQL agree, else what differs."""
    df = query(spark, sf_dir)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows_of(df.columns, df.collect()), rows_of(names, found.fetchall())
    if a == b:
        return ""
    only_a, only_b = [x for x in a if x not in set(b)], [x for x in b if x not in set(a)]
    return f"{len(a)} and {len(b)} rows; {len(only_a)} only in the query, {len(only_b)} only in the SQL; {sorted(df.columns)} {only_a[:2]} {only_b[:2]}"


if __name__ == "__main__":
    import __spark_entry__
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, oracles = database(sf_dir), __spark_entry__.oracle_sql()
    for name, query in __spark_entry__.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        if not sys.argv[2:] and (name == "pipeline" or name.startswith("op")):
            continue
        began = time.time()
        try:
            what = difference(spark, con, sf_dir, query, oracles[name]) if name in oracles else f"rows only: {query(spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001
            what = f"{type(e).__name__} {str(e)[:600]}"
        print(f"{name} {time.time() - began:.1f}s {what or 'equal'}", flush=True)
