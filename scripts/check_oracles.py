"""Run every registered query in Spark and its oracle in DuckDB, compare rows (order-insensitive).

usage: python scripts/check_oracles.py [sf_dir] [name-substring ...]
"""
from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from reviewlake.plans.fixtures import BASE_TABLES  # noqa: E402
from reviewlake.plans.registry import load_all  # noqa: E402
from reviewlake.session import local_session  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    spark = local_session(8)
    con = duckdb.connect()
    for t in BASE_TABLES:
        p = os.path.join(sf, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    reg = load_all()
    bad = 0
    for k, e in sorted(reg.items()):
        if pats and not any(p in k for p in pats):
            continue
        t0 = time.time()
        try:
            df = e.build(spark, sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as ex:  # noqa: BLE001
            print(f"FAIL {k}: spark error {str(ex)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if e.oracle is None:
            print(f"rows {k}: {len(srows)} rows ({ts:.1f}s)")
            continue
        try:
            res = con.execute(e.oracle)
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as ex:  # noqa: BLE001
            print(f"FAIL {k}: duckdb error {str(ex)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {k}: columns spark={sorted(scols)} duck={sorted(dcols)}")
            bad += 1
            continue
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        if a != b:
            bad += 1
            sa, sb = set(a), set(b)
            print(f"FAIL {k}: spark {len(a)} rows duck {len(b)} rows; only spark {list(sa - sb)[:2]} only duck {list(sb - sa)[:2]}")
        else:
            print(f"ok   {k}: {len(a)} rows ({ts:.1f}s)")
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
