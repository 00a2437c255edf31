"""Every query with oracle SQL against DuckDB on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest
from matchgrid.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.5f}".replace("-0.00000", "0.00000")
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, int):
        return f"{float(x):.5f}"
    return x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else str(x)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, sf, name):
    got = registry.QUERIES[name](spark, sf)
    if name not in registry.ORACLE_SQL:
        assert got.count() > 0
        return
    cur = db.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(_plain(x) for x in r) for r in cur.fetchall())
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(_plain(x) for x in r) for r in got.select(*names).collect()) == want
