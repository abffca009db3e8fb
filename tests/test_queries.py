import math

import duckdb
import pytest

from veilgraph import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = Q.queries()[name](spark, SF)
    want = duck.execute(Q.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    rows = sorted((tuple(cell(r[c]) for c in order) for r in got.collect()), key=repr)
    expect = sorted((tuple(cell(r[names.index(c)]) for c in order) for r in want.fetchall()), key=repr)
    assert rows == expect


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_query_runs(spark, name):
    assert Q.queries()[name](spark, SF).count() > 0
