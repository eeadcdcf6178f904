"""Every registered query with SQL gives DuckDB's rows on the small tables."""

import os

import duckdb
import pytest

from lumenfold import queries as Q

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")
    return con


def rows(df):
    columns = sorted(df.columns)
    plain = df[columns].astype(object).where(df[columns].notna(), None)
    return columns, sorted(tuple(f"{float(x):.9g}" if isinstance(x, float) else str(x) for x in r) for r in plain.values.tolist())


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, duck, name):
    got = Q.queries()[name](spark, SMALL)
    want = duck.sql(Q.oracle_sql()[name]).df()
    (columns, a), (others, b) = rows(got.toPandas().astype({c: "Int64" for c in ("dense_rank", "sparse_rank") if c in got.columns})), rows(want)
    assert columns == others
    assert a == b


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(spark, name):
    assert Q.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
