"""Every registered query against its SQL on the smallest tables."""

import pytest

from compare import compare, oracle_connection
from drivetrace.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_connection(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees(spark, sf_dir, con, name):
    problem, rows = compare(name, QUERIES[name](spark, sf_dir), con, ORACLES[name])
    assert not problem
    assert rows > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == entry.queries()["metric_worst_per_window"](spark, entry.SMOKE_DIR).columns
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_no_plan_pairs_all_rows(spark, sf_dir):
    """Joins have real keys: without broadcasts and adaptive plans nothing becomes a nested loop."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        bad = []
        for name, build in QUERIES.items():
            plan = build(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
            if "CartesianProduct" in plan or "NestedLoopJoin" in plan:
                bad.append(name)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert bad == []
