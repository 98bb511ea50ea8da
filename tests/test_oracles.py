"""Every core query with SQL, on Spark and on DuckDB."""

import pytest

from tesselar.plans import catalogue
from tests.compare import connect, differences
from tests.conftest import SMALL

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert differences(QUERIES[name](spark, SMALL), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert len(set(df.columns)) == len(df.columns)
    df.count()


def test_entry_module_needs_no_session():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_cartesian_product_in_graph_plans(spark):
    for name in ("g_top_degree", "bridge_entities", "triangles", "g_cross_jur"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan, name
