"""Every query with SQL gives the same rows as DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from docloom.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in Q.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(rows):
    return sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    if name not in Q.SQL:
        assert got
        return
    found = duck.execute(Q.SQL[name])
    at = [x[0] for x in found.description]
    assert sorted(at) == columns
    assert _plain(got) == _plain(tuple(r[at.index(c)] for c in columns) for r in found.fetchall())
