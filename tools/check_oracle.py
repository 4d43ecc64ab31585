"""Run registered queries in Spark and their DuckDB oracles; compare row sets.

Usage: python tools/check_oracle.py [sf_dir] [key ...]
"""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from uas_spark.plans.registry import ORACLE, QUERIES  # noqa: E402
from uas_spark.session import build_session  # noqa: E402
from uas_spark.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if v is None:
        return None
    return v if isinstance(v, (int, str, bool)) else str(v)


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or list(QUERIES)
    spark = build_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for k in keys:
        t0 = time.time()
        try:
            df = QUERIES[k](spark, sf)
            cols = sorted(df.columns)
            rows = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=_key)
        except Exception as e:  # noqa: BLE001
            print(f"{k:40s} SPARK ERROR {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if k not in ORACLE:
            print(f"{k:40s} rows={len(rows):7d} (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.execute(ORACLE[k])
            names = [d[0] for d in res.description]
            data = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{k:40s} ORACLE ERROR {str(e)[:400]}")
            bad += 1
            continue
        if sorted(names) != cols:
            print(f"{k:40s} SCHEMA MISMATCH spark={cols} oracle={sorted(names)}")
            bad += 1
            continue
        idx = [names.index(c) for c in cols]
        orows = sorted((tuple(_norm(r[i]) for i in idx) for r in data), key=_key)
        ok = orows == rows
        bad += not ok
        print(f"{k:40s} rows={len(rows):7d} oracle={len(orows):7d} {'OK' if ok else 'MISMATCH'} {ts:.1f}s")
        if not ok:
            s1, s2 = set(rows), set(orows)
            print("   only spark :", sorted(s1 - s2, key=_key)[:3])
            print("   only oracle:", sorted(s2 - s1, key=_key)[:3])
    print("failures:", bad)


if __name__ == "__main__":
    main()
