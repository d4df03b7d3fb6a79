"""Every registered query against its SQL, and the shape of its plan."""

import pytest
from check import compare, connect

import __spark_entry__ as entry
from sparkmoor.plans.catalog import REGISTRY


@pytest.fixture(scope="module")
def con(root):
    return connect(root)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, root, con, name, capsys):
    q = REGISTRY[name]
    df = q.run(spark, root)
    assert compare(df, con, q.sql) is None
    capsys.readouterr()
    df.explain()
    plan = capsys.readouterr().out
    assert "Physical Plan" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "dim", "value"]
