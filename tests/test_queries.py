"""Every registered query against its DuckDB oracle on the smallest scale factor, plus entry()."""
import math

import duckdb
import pytest

import __spark_entry__ as entry_mod
from tonekit.plans.oracles import ORACLES
from tonekit.plans.queries import QUERIES
from tonekit.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
NAMES = sorted(QUERIES)
#: Queries that SQL cannot express (tested on held-out labels instead).
NO_SQL = {"score_ordinal_trained"}
#: Queries whose rows come in an order that is part of the result.
ORDERED = {"sort_sentences"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (2, v)
    if hasattr(v, "isoformat"):
        return (3, v.isoformat())
    if isinstance(v, int) and not isinstance(v, bool):
        return (4, v)
    return (5, str(v))


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def test_every_query_has_an_oracle():
    assert set(NAMES) - set(ORACLES) == NO_SQL and set(ORACLES) <= set(NAMES)


@pytest.mark.parametrize("name", [n for n in NAMES if n not in NO_SQL])
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLES[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _rows(df.columns, srows) == _rows(dcols, drows)
    if name in ORDERED:
        assert srows == [tuple(r[dcols.index(c)] for c in df.columns) for r in drows]


def test_entry_lists_these_queries():
    assert set(NAMES) <= set(entry_mod.queries()) and all(entry_mod.oracle_sql()[n] == sql for n, sql in ORACLES.items())


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["lang", "n_sentences", "mean_compound", "mean_polarity", "median_compound"]
