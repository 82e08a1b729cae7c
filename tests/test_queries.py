"""Every query against its SQL on the smallest tables, where those are there."""

import os

import pytest

from scholia.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    if name not in ORACLES:
        assert got
        return
    expected = db.execute(ORACLES[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got) == sorted(repr(tuple(r)) for r in expected.fetchall())
