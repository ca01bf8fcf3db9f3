"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

usage: python tools/compare.py [--sf DIR] [--only k1,k2] [--prefix p] [--json out]
Compares column names, row counts and the order-insensitive multiset of rows.
"""

from __future__ import annotations

import argparse
import json
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def norm_val(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(norm_val(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm_val(x)) for k, x in v.items()))
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm_val(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--only", default="")
    ap.add_argument("--prefix", default="")
    ap.add_argument("--json", default="")
    a = ap.parse_args()

    from voxframe.plans import load_all
    from voxframe.session import get_spark
    from voxframe.views import TABLES

    queries, oracle = load_all()
    keys = [k for k in queries if (not a.only or k in a.only.split(",")) and k.startswith(a.prefix)]
    spark = get_spark()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    res = {}
    nbad = 0
    for k in keys:
        t0 = time.time()
        try:
            df = queries[k](spark, a.sf)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            res[k] = {"status": "spark_error", "error": str(e)[:400]}
            print(f"{k:28s} SPARK ERROR {str(e)[:300]}")
            traceback.print_exc(limit=2)
            nbad += 1
            continue
        ts = time.time() - t0
        if k not in oracle:
            res[k] = {"status": "rows_only", "rows": len(rows)}
            print(f"{k:28s} rows-only rows={len(rows)} {ts:.1f}s")
            continue
        try:
            cur = con.execute(oracle[k])
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            res[k] = {"status": "oracle_error", "error": str(e)[:400]}
            print(f"{k:28s} ORACLE ERROR {str(e)[:300]}")
            nbad += 1
            continue
        ok_cols = sorted(cols) == sorted(ocols)
        ok_n = len(rows) == len(orows)
        ok_v = ok_cols and ok_n and canon(cols, rows) == canon(ocols, orows)
        st = "ok" if ok_v else "MISMATCH"
        if not ok_v:
            nbad += 1
        res[k] = {"status": st, "rows": len(rows), "orows": len(orows), "cols": ok_cols}
        print(f"{k:28s} {st} rows={len(rows)}/{len(orows)} cols={'ok' if ok_cols else (sorted(cols), sorted(ocols))} {ts:.1f}s")
        if not ok_v and ok_cols and ok_n:
            a1, b1 = canon(cols, rows), canon(ocols, orows)
            diff = [(x, y) for x, y in zip(a1, b1) if x != y][:3]
            print("   first diffs:", str(diff)[:800])
    print(f"done: {len(keys)} keys, {nbad} bad")
    if a.json:
        json.dump(res, open(a.json, "w"), indent=1)


if __name__ == "__main__":
    main()
