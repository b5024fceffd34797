"""Benchmark: run the registered queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is executed completely with the ``noop`` sink (all rows and columns are computed,
nothing is collected to the driver). A warm-up pass on the smallest scale factor runs first
so JVM start-up and code generation are not billed to the first query.
Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tonekit.plans.queries import QUERIES  # noqa: E402
from tonekit.session import build_session, ensure_checkpoint_dir  # noqa: E402

HEADLINE = ("lang_summary", "sentiment_table", "language_id", "score_negation", "agreement_pct",
            "corr_info", "crosstab_classes", "kde_by_corpus", "mann_whitney", "median_by_group",
            "hist_by_group", "series_by_id", "tokenize_words", "page_extract", "dedupe_text",
            "top_n_per_group", "csv_roundtrip")


def run(spark, name: str, sf_dir: str) -> float:
    t = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="tonekit-bench-"))
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        for name in HEADLINE:
            try:
                run(spark, name, warm)
            except Exception:  # warm-up only
                pass
    times, errors = {}, {}
    for name in names:
        try:
            times[name] = round(run(spark, name, sf_dir), 3)
        except Exception as exc:  # report the failure, keep measuring the rest
            errors[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "headline_sec": round(sum(times[n] for n in HEADLINE if n in times), 3),
        "sf": float(m.group(1)) if m else sf_dir,
        **({"errors": errors} if errors else {}),
    }))


if __name__ == "__main__":
    main()
