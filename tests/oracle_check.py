"""Compare registered queries with their SQL on one data folder.

Usage: python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def kind(t: str) -> str:
    t = t.lower()
    if t in ("bigint", "integer", "int", "long"):
        return "int"
    if t in ("double", "float"):
        return "float"
    if t in ("varchar", "string"):
        return "str"
    return t


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}") + 0.0
    return v


def compare(spark_rows, spark_types, duck_rows, duck_types) -> str | None:
    """None when equal, else a one-line reason."""
    sn, dn = sorted(spark_types), sorted(duck_types)
    if sn != dn:
        return f"columns differ: {sn} vs {dn}"
    bad = [(c, spark_types[c], duck_types[c]) for c in sn if kind(spark_types[c]) != kind(duck_types[c])]
    if len(spark_rows) != len(duck_rows):
        return f"row counts {len(spark_rows)} vs {len(duck_rows)}"

    def key(row):
        return tuple((v is None, str(type(v)), v) if not isinstance(v, float) else (False, "f", round(v, 5)) for v in row)

    a = sorted((tuple(_norm(r[c]) for c in sn) for r in spark_rows), key=key)
    b = sorted((tuple(_norm(r[c]) for c in sn) for r in duck_rows), key=key)
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        x, y = diff[0]
        cols = [c for c, p, q in zip(sn, x, y) if p != q]
        return f"{len(diff)} rows differ on {cols}: {str([p for p, q in zip(x, y) if p != q])[:300]} vs {str([q for p, q in zip(x, y) if p != q])[:300]}"
    if bad:
        return f"types differ: {bad}"
    return None


def check(spark, con, sf: str, name: str, entry) -> tuple[str | None, int, float]:
    t0 = time.time()
    df = entry.build(spark, sf)
    rows = [r.asDict() for r in df.collect()]
    took = time.time() - t0
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if entry.sql is None:
        return None, len(rows), took
    cur = con.execute(entry.sql)
    names = [d[0] for d in cur.description]
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    drows = [dict(zip(names, r)) for r in cur.fetchall()]
    return compare(rows, types, drows, dtypes), len(rows), took


def main() -> int:
    from pagegrain.plans.registry import load_all
    from pagegrain.session import build_session

    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    prefixes = [a for a in args if not a.startswith("/")]
    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    failed = 0
    for name, entry in load_all().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            reason, n, took = check(spark, con, sf, name, entry)
        except Exception as e:  # report and go on
            reason, n, took = f"{type(e).__name__}: {str(e)[:700]}", -1, 0.0
        mark = "ok  " if reason is None else "FAIL"
        failed += reason is not None
        kindof = "sql" if entry.sql else "rows"
        print(f"{mark} {name:40s} {kindof} rows={n} {took:.1f}s {reason or ''}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
