"""The queries of this subpackage that have SQL, against it."""

import duckdb
import pytest

from tessera.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    frame = c.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(frame.columns)
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    rows = sorted((tuple(plain(v) for v in r) for r in got.select(*frame.columns).collect()), key=repr)
    assert rows == sorted((tuple(plain(v) for v in r) for r in frame.fetchall()), key=repr)
