"""Every query of the engine's own operators against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from spoolwave.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{SF}/{name}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((repr(tuple(plain(r[c]) for c in cols)) for r in df.collect()))
    cur = duck.execute(ORACLE_SQL[name])
    named = [d[0] for d in cur.description]
    assert sorted(named) == cols
    assert got == sorted(repr(tuple(plain(r[named.index(c)]) for c in cols)) for r in cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
