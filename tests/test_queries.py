"""Every query with SQL gives the rows that the SQL gives; every other one runs and has stable columns."""

import pytest

from cartalog.plans import general, relational, spatial_graph
from tests.oracle import both, connection

QUERIES = {**general.QUERIES, **relational.QUERIES, **spatial_graph.QUERIES}
SQL = {**general.SQL, **relational.SQL, **spatial_graph.SQL}


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, con, name):
    ours, theirs = both(spark, con, sf, QUERIES[name], SQL[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert len(df.collect()) > 0 and len(set(df.columns)) == len(df.columns)
