"""Every registered library query that has a SQL counterpart gives its rows."""

import os

import duckdb
import pytest

from lumenshelf import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    cur = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cur.description]
    order = sorted(df.columns)
    assert sorted(names) == order
    want = sorted(repr(tuple(dict(zip(names, r, strict=True))[c] for c in order)) for r in cur.fetchall())
    assert sorted(repr(tuple(r[c] for c in order)) for r in df.collect()) == want
