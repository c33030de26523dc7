"""Every query with SQL gives DuckDB's rows; the others give rows of a stable kind."""

import duckdb
import pytest

import __spark_entry__
from weftline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(columns).collect()]
    if name in catalog.ORACLES:
        found = duck.execute(catalog.ORACLES[name])
        names = [d[0] for d in found.description]
        order = [names.index(c) for c in columns]
        want = [tuple(plain(r[i]) for i in order) for r in found.fetchall()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    else:
        assert got and name not in catalog.ORACLES


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
