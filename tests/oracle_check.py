"""Run queries() against oracle_sql() the way the driver does.

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return 0.0 if v == 0 else v
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple(norm(x) for x in rec))
    return cols, sorted(out, key=repr)


def compare(spark, sf_dir, names=None, verbose=True):
    from __spark_entry__ import oracle_sql, queries
    qs, sq = queries(), oracle_sql()
    con = duck(sf_dir)
    res = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            sp = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            res[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            print(name, res[name], flush=True)
            continue
        t1 = time.time()
        if name not in sq:
            res[name] = f"rows-only {len(sp)}"
            print(f"{name}: {res[name]}  ({t1 - t0:.1f}s)", flush=True)
            continue
        try:
            dd = con.execute(sq[name]).df()
        except Exception as e:  # noqa: BLE001
            res[name] = f"SQL ERROR {str(e)[:300]}"
            print(name, res[name], flush=True)
            continue
        c1, r1 = rows_of(sp)
        c2, r2 = rows_of(dd)
        if c1 != c2:
            res[name] = f"COLUMNS {c1} vs {c2}"
        elif len(r1) != len(r2):
            res[name] = f"ROWCOUNT {len(r1)} vs {len(r2)}"
        elif r1 != r2:
            bad = [(a, b) for a, b in zip(r1, r2) if a != b][:3]
            res[name] = f"VALUES differ, e.g. {bad}"
        else:
            res[name] = f"ok {len(r1)}"
        print(f"{name}: {res[name]}  ({t1 - t0:.1f}s spark)", flush=True)
    return res


if __name__ == "__main__":
    from qoeflow.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = build_session("local[8]")
    r = compare(spark, sf, names)
    bad = [k for k, v in r.items() if not (v.startswith("ok") or v.startswith("rows-only"))]
    print("FAILED:", bad)
