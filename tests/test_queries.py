"""Every query against the SQL that gives the same rows."""

import duckdb
import pytest

from larkspan import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return None if v is None else round(float(v), 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, con, name):
    got = registry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    assert cols == sorted(con.sql(registry.oracle_sql()[name]).columns)
    rows = lambda r: sorted(str([plain(v) for v in x]) for x in r)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert rows(got.select(*cols).collect()) == rows(want)
