"""Results must not depend on how the data is partitioned (distributed ranks, prefix sums, top-n)."""
import pytest

from tonekit.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ["panel_index", "drop_position", "median_by_group", "mann_whitney", "top_n_per_group",
         "rolling_mean5", "dedupe_text", "hist_by_group", "lang_summary"]


def _run(spark, name, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return sorted(tuple(r) for r in QUERIES[name](spark, SF).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("name", NAMES)
def test_same_result_for_1_and_37_partitions(spark, name):
    assert _run(spark, name, 1) == _run(spark, name, 37)
