"""Compare registered queries with their SQL twins: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _sorted(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def spark_rows(df):
    return _sorted(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return _sorted(cols, cur.fetchall())


def difference(df, con, sql) -> str | None:
    """None when equal, else what differs first."""
    sc, sr = spark_rows(df)
    dc, dr = duck_rows(con, sql)
    if sc != dc:
        return f"columns {sc} != {dc}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} != {len(dr)}; first {sr[:1]} {dr[:1]}"
    for a, b in zip(sr, dr):
        for x, y, c in zip(a, b, sc):
            if x != y or (x is not None and type(x) is not type(y)):
                return f"column {c}: {x!r} != {y!r}; row {a} vs {b}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from epochwise.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    con = duck(sf_dir)
    bad = 0
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name, fn in queries.items():
        if names and not any(n == name if not n.endswith("*") else name.startswith(n[:-1]) for n in names):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                diff = difference(df, con, sqls[name])
                state = "ok" if diff is None else "DIFF " + diff[:600]
            else:
                state = f"rows {len(df.collect())}"
        except Exception as e:  # the report goes on to the next query
            state = "ERROR " + str(e)[:900]
        bad += state.startswith(("DIFF", "ERROR"))
        print(f"{name:28s} {time.time() - t:6.2f}s {state}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
