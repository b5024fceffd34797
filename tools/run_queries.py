"""Run registered queries on one scale factor and print row counts and timings."""
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from tonekit.plans.queries import QUERIES  # noqa: E402
from tonekit.session import build_session  # noqa: E402

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("local[8]", shuffle_partitions=8)
    for name in names:
        t = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            n = df.count()
            print(f"{name:24s} rows={n:8d} {time.time()-t:6.2f}s  {df.schema.simpleString()[:150]}", flush=True)
        except Exception as e:  # report and go on
            print(f"{name:24s} ERROR {type(e).__name__}: {str(e)[:400]}", flush=True)
