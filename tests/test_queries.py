"""Every registered query: against DuckDB where it has SQL, else at least rows with a stable schema."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        _, problems = compare(df, con, ORACLES[name])
        assert not problems
    else:
        assert df.columns and not df.isEmpty()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_plans_stay_free_of_pair_joins(spark, sf_dir):
    for name in ("tag_triples", "hex_adjacency", "topology_points", "idw", "idw_power", "dated_slices", "ontology_triples", "bfs_paths"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name
