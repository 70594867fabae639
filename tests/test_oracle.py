"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from scanloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return out


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_matches_sql(spark, sf, con, name):
    found = catalog.queries()[name](spark, sf)
    columns = sorted(found.columns)
    mine = sorted(repr(tuple(map(_plain, r))) for r in found.select(*columns).collect())
    answer = con.execute(catalog.oracles()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted(repr(tuple(_plain(r[k]) for k in order)) for r in answer.fetchall())
    assert mine == theirs
