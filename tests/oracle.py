"""Side-by-side run of catalog queries in Spark and DuckDB.

Usage: python tests/oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or value is pd.NaT:
        return None
    if hasattr(value, "to_pydatetime"):
        value = value.to_pydatetime()
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return value
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_plain(row[i]) for i in order]) for row in rows)


def compare(spark_df, con, sql):
    """Returns (equal, message)."""
    mine_cols = spark_df.columns
    mine = [tuple(r) for r in spark_df.collect()]
    got = con.execute(sql)
    cols = [d[0] for d in got.description]
    theirs = got.fetchall()
    if sorted(cols) != sorted(mine_cols):
        return False, f"columns {sorted(mine_cols)} vs {sorted(cols)}"
    a, b = _rows(mine_cols, mine), _rows(cols, theirs)
    if a == b:
        return True, f"{len(a)} rows"
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return False, f"{len(a)} vs {len(b)} rows; spark only {len(only_a)} {only_a[:3]}; sql only {len(only_b)} {only_b[:3]}"


def main():
    import __spark_entry__ as entry
    from tsforge.session import session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = args.names or list(queries)
    bad = 0
    for name in names:
        begin = time.time()
        try:
            if name in oracles:
                ok, message = compare(queries[name](spark, folder), con, oracles[name])
            else:
                ok, message = True, f"{queries[name](spark, folder).count()} rows (no oracle)"
        except Exception as error:
            ok, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:24s} {time.time() - begin:6.2f}s {message}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
