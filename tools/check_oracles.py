"""Compare every registered Spark query with its DuckDB oracle (row count, columns, values).

Usage: python tools/check_oracles.py [sf_dir] [query ...]
Values are compared order-insensitively after sorting columns by name; doubles are compared
exactly and, when that fails, again with a 1e-9 relative tolerance (reported as 'close').
"""
import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

import duckdb  # noqa: E402

from tonekit.plans.oracles import ORACLES  # noqa: E402
from tonekit.plans.queries import QUERIES  # noqa: E402
from tonekit.session import build_session  # noqa: E402
from tonekit.sources.tables import TABLES  # noqa: E402


def norm(v, tol):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        if tol:
            return (2, float(f"{v:.9g}"))
        return (2, v)
    if hasattr(v, "isoformat"):
        return (3, v.isoformat())
    if isinstance(v, (int,)) and not isinstance(v, bool):
        return (2, float(v)) if tol else (4, v)
    return (5, str(v))


def rows_of(cols, rows, tol):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i], tol) for i in order) for r in rows)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    spark = build_session("local[8]", shuffle_partitions=8)
    bad = 0
    for name in names:
        if name not in ORACLES:
            print(f"{name:22s} NO-ORACLE")
            continue
        t0 = time.time()
        try:
            sdf = QUERIES[name](spark, sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
            t1 = time.time()
            res = con.execute(ORACLES[name])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
            t2 = time.time()
        except Exception as e:
            bad += 1
            print(f"{name:22s} ERROR {type(e).__name__}: {str(e)[:600]}")
            continue
        status = "OK"
        if sorted(scols) != sorted(dcols):
            status = f"COLUMNS spark={scols} duck={dcols}"
        elif len(srows) != len(drows):
            status = f"ROWCOUNT spark={len(srows)} duck={len(drows)}"
        elif rows_of(scols, srows, False) != rows_of(dcols, drows, False):
            if rows_of(scols, srows, True) == rows_of(dcols, drows, True):
                status = "CLOSE (float ulp)"
            else:
                a, b = rows_of(scols, srows, False), rows_of(dcols, drows, False)
                diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
                status = f"VALUES {diff}"
        if status != "OK":
            bad += 1
        print(f"{name:22s} {status[:900]}  rows={len(srows)} spark={t1-t0:.1f}s duck={t2-t1:.1f}s", flush=True)
    print(f"mismatches: {bad}")


if __name__ == "__main__":
    main()
