"""Compare registered queries with their DuckDB text: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, Decimal):
        return repr(round(float(v), 6))
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, int):
        return repr(v)
    return str(v)


def rows_of(names, rows):
    idx = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in idx) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = df.collect()
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(df.columns) != sorted(names):
        return len(got), f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        kinds = {n: str(t) for n, t in zip(names, [d[1] for d in res.description])}
        loose = [n for n, t in df.dtypes if (t in ("bigint", "int", "double")) and {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE"}[t] != kinds[n]]
        return len(got), f"ok (types differ: {[(n, dict(df.dtypes)[n], kinds[n]) for n in loose]})" if loose else "ok"
    left = [r for r in a if r not in set(b)][:3]
    right = [r for r in b if r not in set(a)][:3]
    return len(got), f"MISMATCH {len(a)} vs {len(b)}\n   spark {str(left)[:700]}\n   duck  {str(right)[:700]}"


def main():
    from __spark_entry__ import oracle_sql, queries

    from parlance.session import build_session

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    pick = [q for q in qs if not args[1:] or any(q.startswith(a) for a in args[1:])]
    bad = 0
    for q in pick:
        t = time.time()
        try:
            if q in sqls:
                n, msg = compare(spark, con, qs[q], sqls[q], sf_dir)
            else:
                n, msg = len(qs[q](spark, sf_dir).collect()), "rows only"
        except Exception as e:  # noqa: BLE001
            n, msg = -1, f"ERROR {type(e).__name__} {str(e)[:900]}"
        if not (msg.startswith("ok") or msg == "rows only"):
            bad += 1
        print(f"{q:40s} {n:7d} {time.time() - t:6.2f}s {msg}", flush=True)
    print("bad:", bad, "of", len(pick))


if __name__ == "__main__":
    main()
