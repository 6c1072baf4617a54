"""Every registered query against its SQL on the smallest tables, as the driver compares them."""

import os

import duckdb
import pytest

from bitweave.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        return
    want = sql.sql(ORACLES[name])
    assert sorted(want.columns) == sorted(df.columns)
    order = sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted(str([plain(r[c]) for c in order]) for r in rows)
    assert got == sorted(str([plain(dict(zip(want.columns, r, strict=True))[c]) for c in order]) for r in want.fetchall())
