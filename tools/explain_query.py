"""Print the formatted physical plan of registered queries.

Usage: python tools/explain_query.py [sf_dir] query [query ...]
With --after, the query runs first and the final adaptive plan is printed.
"""
import sys
import tempfile

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from tonekit.plans.queries import QUERIES  # noqa: E402
from tonekit.session import build_session, ensure_checkpoint_dir  # noqa: E402

if __name__ == "__main__":
    args = [a for a in sys.argv[1:] if a != "--after"]
    after = "--after" in sys.argv
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = build_session("local[8]", shuffle_partitions=8)
    ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="tonekit-explain-"))
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        if after:
            df.write.format("noop").mode("overwrite").save()
        print(f"==== {name} ====")
        df.explain("formatted")
