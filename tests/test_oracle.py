"""Every registered query against its SQL."""

import pytest
from check import compare, connect

import __spark_entry__ as entry
from shardflow.plans import all_queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries.QUERIES, all_queries.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert sorted(r.worker for r in rows) == [0, 1, 2, 3]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    plans = []

    def run(spark, sf_dir):
        df = QUERIES[name](spark, sf_dir)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    assert compare(spark, con, SF, run, ORACLES[name]) is None
    assert "CartesianProduct" not in plans[0] and "NestedLoopJoin" not in plans[0]
