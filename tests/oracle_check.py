"""Run registered queries and their SQL twins side by side: python tests/oracle_check.py [pattern] [sf]"""

from __future__ import annotations

import math
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)):
        return round(float(v), 6)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, fn, sql, sf_dir, show=True):
    t = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - t
    if sql is None:
        return True, f"{name}: rows-only {len(got)} rows, {len(df.columns)} cols, {took:.1f}s"
    t = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    dtook = time.time() - t
    if sorted(cols) != sorted(df.columns):
        return False, f"{name}: COLUMNS {sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    kinds = {c: str(d[1]) for c, d in zip(cols, cur.description)}
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    loose = []
    pairs = {"bigint": ("BIGINT",), "int": ("INTEGER",), "double": ("DOUBLE",), "string": ("VARCHAR",),
             "boolean": ("BOOLEAN",), "timestamp_ntz": ("TIMESTAMP",), "timestamp": ("TIMESTAMP",),
             "date": ("DATE",)}
    for c in cols:
        if types[c] in pairs and kinds[c] not in pairs[types[c]]:
            loose.append(f"{c}:{types[c]}/{kinds[c]}")
    ok = a == b
    msg = f"{name}: {'ok' if ok else 'MISMATCH'} {len(a)}/{len(b)} rows spark {took:.1f}s duck {dtook:.1f}s"
    if loose:
        msg += "  TYPES " + ", ".join(loose)
    if not ok and show:
        sa, sb = set(a), set(b)
        only_a = [r for r in a if r not in sb][:3]
        only_b = [r for r in b if r not in sa][:3]
        msg += f"\n   cols {sorted(cols)}\n   spark {only_a}\n   duck  {only_b}"
    return ok, msg


def main():
    from registry import ALL, SQL, load_all
    from siltmark.session import local_session
    load_all()
    pattern = sys.argv[1] if len(sys.argv) > 1 else "."
    sf_dir = f"/root/testdata/sf{sys.argv[2] if len(sys.argv) > 2 else '0.01'}"
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    con = duck(sf_dir)
    bad = []
    for name, fn in ALL.items():
        if not re.search(pattern, name):
            continue
        try:
            ok, msg = compare(spark, con, name, fn, SQL.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{name}: ERROR {type(e).__name__} {str(e)[:1200]}"
        print(msg, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} bad: {bad}", flush=True)


if __name__ == "__main__":
    main()
