"""Each registered query against its SQL, over the smallest driver tables."""

import os

import pytest

from coterie.plans.oracle import ORACLE
from coterie.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if isinstance(v, float):
        return int(v) if v.is_integer() else round(v, 9)
    return v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    relation = con.sql(ORACLE[name])
    assert sorted(relation.columns) == columns
    order = ", ".join(f'"{c}"' for c in columns)
    want = con.sql(f"SELECT {order} FROM ({ORACLE[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    key = lambda r: tuple(map(str, map(plain, r)))
    assert sorted(map(key, got)) == sorted(map(key, want))
    spark.catalog.clearCache()


def test_every_query_is_registered():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLE) <= set(__spark_entry__.oracle_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
