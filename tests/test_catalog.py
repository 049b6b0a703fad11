"""Every query with SQL must give the same rows as that SQL in another engine; the others must give rows."""

import math
import os

import pytest

from tessera.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return repr([canon(x) for x in v])
    return repr(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [r.asDict(True) for r in df.collect()]
    assert rows
    if name in ORACLE:
        out = duck.sql(ORACLE[name])
        assert sorted(out.columns) == sorted(df.columns)
        want = [dict(zip(out.columns, r, strict=True)) for r in out.fetchall()]
        key = lambda r: tuple(canon(r[c]) for c in sorted(r))
        assert sorted(map(key, rows)) == sorted(map(key, want))
