"""Every registered tabular query against its DuckDB twin, on the smallest tables."""

import os

import duckdb
import pytest

from gridsmith import catalogue

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def plain(v):
    return v.item() if hasattr(v, "item") else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equal(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    rel = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(columns)
    got = sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in df.collect())
    want = sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in rel.fetchall())
    assert got == want
