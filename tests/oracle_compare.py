"""Run registered queries in Spark and their oracle SQL in DuckDB; compare like the driver does.

usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""
from __future__ import annotations

import math
import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    import pandas as pd
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(df_pd):
    cols = sorted(df_pd.columns)
    out = []
    for rec in df_pd[cols].itertuples(index=False):
        out.append(tuple(norm(x) for x in rec))
    return cols, sorted(out, key=repr)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    from tunekiln.session import get_session
    spark = get_session()
    qs, sql = E.queries(), E.oracle_sql()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    ok = bad = 0
    for name in (names or sorted(qs)):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf)
            spd = sdf.toPandas()
        except Exception:
            msg = traceback.format_exc().strip().splitlines()[-1][:600]
            print(f"FAIL {name}: spark error {msg}")
            bad += 1
            continue
        dt = time.time() - t0
        if name not in sql:
            print(f"ROWS {name}: {len(spd)} rows ({dt:.1f}s)")
            continue
        try:
            dpd = con.sql(sql[name]).df()
        except Exception as e:
            print(f"FAIL {name}: duckdb error {e}")
            bad += 1
            continue
        sc, sr = rows_of(spd)
        dc, dr = rows_of(dpd)
        if sc != dc:
            print(f"FAIL {name}: columns {sc} vs {dc}")
            bad += 1
        elif sr != dr:
            diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
            print(f"FAIL {name}: {len(sr)} vs {len(dr)} rows; first diffs {diff}")
            bad += 1
        else:
            print(f"OK   {name}: {len(sr)} rows ({dt:.1f}s)")
            ok += 1
    print(f"== {ok} ok, {bad} failed")


if __name__ == "__main__":
    main()
