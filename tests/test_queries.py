from __future__ import annotations

import os

import duckdb
import pytest

from folioscan.plans import core, documents, library, upkeep  # noqa: F401
from folioscan.sources.tables import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = lambda v: round(float(v), 6) if isinstance(v, float) else v
    return sorted(([clean(r[k]) for k in order] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_against_sql(spark, duck, name):
    got, want = core.QUERIES[name](spark, SF), duck.sql(core.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(documents.QUERIES) - set(core.SQL)))
def test_query_runs(spark, name):
    assert documents.QUERIES[name](spark, SF).count() > 0
