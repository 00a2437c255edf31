"""Every training-data query with oracle SQL against DuckDB on the smallest tables."""

import duckdb
import pytest
from matchgrid.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_oracle(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages", "conversations"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    cur = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    plain = lambda rows: sorted(tuple(f"{x:.5f}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert plain(got.select(*names).collect()) == plain(cur.fetchall())
