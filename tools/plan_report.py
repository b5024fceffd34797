"""Write PLANS.md: the physical shape of every registered query (final AQE plan after a run).

Usage: python tools/plan_report.py [sf_dir] > PLANS.md
Counts shuffle exchanges, broadcast exchanges and sorts, and lists each Parquet scan with the
columns it reads and the filters pushed into it.
"""
import re
import sys
import tempfile

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from tonekit.plans.queries import QUERIES  # noqa: E402
from tonekit.session import build_session, ensure_checkpoint_dir  # noqa: E402


def shape(plan: str) -> dict:
    scans = [(t, c, f) for c, t, f in re.findall(
        r"FileScan parquet [^\[]*\[([^\]]*)\][^\n]*?Location: [^\n]*?/([a-z_]+)\.parquet[^\n]*?"
        r"PushedFilters: \[([^\]]*)\]", plan)]
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "sorts": len(re.findall(r"\bSort \[", plan)),
        "scans": sorted({(t, len(c.split(",")), f) for t, c, f in scans}),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="tonekit-plans-"))
    print("# PLANS — physical shape of every registered query\n")
    print(f"Generated by `tools/plan_report.py` on `{sf_dir}` (final AQE plans after execution, local[8]).")
    print("Shuffles count hash, range and single-partition exchanges; materialized value-count tables")
    print("(checkpoints) read by later steps appear as their own small scans. `cols` is the number of")
    print("columns the Parquet scan reads.\n")
    print("| query | shuffles | broadcasts | sorts | parquet scans (table: cols, pushed filters) |")
    print("| --- | --- | --- | --- | --- |")
    for name, fn in QUERIES.items():
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = shape(plan)
        scans = "; ".join(f"{t}: {n} cols" + (f", [{f[:70]}]" if f else "") for t, n, f in s["scans"]) or "—"
        print(f"| `{name}` | {s['shuffles']} | {s['broadcasts']} | {s['sorts']} | {scans} |")


if __name__ == "__main__":
    main()
