import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names_match():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and "p4_found" in q


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rnd = lambda v: round(float(v), 6) if isinstance(v, float) else v
    mine = sorted((tuple(rnd(r[x]) for x in cols) for r in df.collect()), key=repr)
    theirs = sorted((tuple(rnd(x) for x in r) for r in c.sql(entry.oracle_sql()[name]).select(*[f'"{x}"' for x in cols]).fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_flagship(spark):
    assert entry.entry(spark).count() >= 0
