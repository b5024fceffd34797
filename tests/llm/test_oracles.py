"""Queries of this subpackage that SQL can express, against their SQL."""
import math

import duckdb
import pytest

from tonekit.llm.registry import ORACLES, QUERIES


def _row(row):
    return tuple(round(v, 9) if isinstance(v, float) and math.isfinite(v) else v for v in row)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"op7_topk", "op13_license_scan"}))  # these have tests of their own
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    res = con.execute(ORACLES[name])
    columns = [d[0] for d in res.description]
    want = sorted(map(_row, res.fetchall()), key=str)
    got = sorted((_row(r) for r in QUERIES[name](spark, sf_dir).select(*columns).collect()), key=str)
    assert got == want
