"""Run queries on Spark and their SQL on DuckDB, and compare the rows.

usage: python tools/compare.py FOLDER [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=repr)


def _close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, (int, float)) or isinstance(b, float) and isinstance(a, int):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


def compare(df, con, sql: str) -> str:
    """'same', 'close' (only the last digits differ) or a description of the difference."""
    names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    wanted_names, wanted = _rows([d[0] for d in cur.description], cur.fetchall())
    if names != wanted_names:
        return f"columns {names} != {wanted_names}"
    if len(got) != len(wanted):
        return f"{len(got)} rows != {len(wanted)}; {got[:2]} {wanted[:2]}"
    kinds = {n: t for n, t in df.dtypes}
    types = {d[0]: str(d[1]) for d in cur.description}
    odd = [f"{n}: {kinds[n]} / {types[n]}" for n in names if _family(kinds[n]) != _family(types[n])]
    if odd:
        return f"types {odd}"
    if got == wanted:
        return "same"
    bad = [(a, b) for a, b in zip(got, wanted) if not all(_close(x, y) for x, y in zip(a, b))]
    if not bad:
        return "close"
    return f"{len(bad)} of {len(got)} rows differ: {bad[0]}"


def _family(kind: str) -> str:
    kind = kind.lower()
    for family, starts in {"long": ("bigint", "long"), "int": ("int", "integer"), "double": ("double",),
                           "text": ("string", "varchar"), "bool": ("boolean", "bool"), "time": ("timestamp",),
                           "list": ("array", "list")}.items():
        if kind.startswith(starts) and not (family == "int" and kind.startswith("interval")):
            return family
    return "list" if kind.endswith("[]") else kind


def session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").appName("compare")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    from sievework.catalog import all_queries, all_sql
    folder, names = sys.argv[1], sys.argv[2:]
    spark, con, sql = session(), connect(folder), all_sql()
    failed = 0
    for name, run in all_queries().items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            verdict = compare(df, con, sql[name]) if name in sql else f"rows {len(df.collect())}"
        except Exception as exc:  # report and go on with the next query
            verdict = f"ERROR {type(exc).__name__}: {str(exc)[:600]}"
        ok = verdict in ("same", "close") or verdict.startswith("rows ")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
