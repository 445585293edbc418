"""Run registered queries against their DuckDB statements and compare whole results."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return v + 0.0
    return v


def compare(spark, con, name: str, run, text: str | None, sf_dir: str) -> dict:
    started = time.time()
    df = run(spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(normal(r[c]) for c in columns) for r in df.select(*columns).collect()]
    spark_s = time.time() - started
    out = {"name": name, "rows": len(rows), "spark_s": round(spark_s, 2), "ok": None}
    if text is None:
        return out
    started = time.time()
    cursor = con.execute(text)
    names = [d[0] for d in cursor.description]
    order = [names.index(c) for c in columns]
    other = [tuple(normal(r[i]) for i in order) for r in cursor.fetchall()]
    out["duck_s"] = round(time.time() - started, 2)
    left, right = Counter(rows), Counter(other)
    out["ok"] = left == right and sorted(names) == columns
    if not out["ok"]:
        out["duck_rows"] = len(other)
        out["columns"] = columns
        out["only_spark"] = list((left - right).elements())[:3]
        out["only_duck"] = list((right - left).elements())[:3]
        out["n_diff"] = sum((left - right).values())
    return out


if __name__ == "__main__":
    import __spark_entry__ as entry

    from shelfweek.session import build_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(
        "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    checks = entry.oracle_sql()
    for name, run in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            result = compare(spark, con, name, run, checks.get(name), sf_dir)
        except Exception as failure:  # noqa: BLE001 - report and go on
            result = {"name": name, "ok": False, "error": str(failure)[:1500]}
        print("FAIL" if result["ok"] is False else "ok  ", result, flush=True)
