import re
from pathlib import Path

import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def test_entry_returns_rows(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "effective_rate" in df.columns


def test_every_query_has_a_sql_twin():
    assert entry_module.QUERIES.keys() == entry_module.ORACLES.keys()
    assert entry_module.oracle_sql().keys() <= entry_module.queries().keys()


def test_queries_build_no_product_joins(spark):
    """Plans of the join-heavy queries hold no cartesian product."""
    for name in ("role_playing_lookup", "point_in_polygon", "complete_grid", "fallback_lookup", "tiles"):
        plan = entry_module.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_filters_and_columns_reach_the_scan(spark):
    df = entry_module.queries()["literal_membership"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), In(o_orderpriority" in plan or "In(o_orderpriority" in plan
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderpriority:string>", plan)


@pytest.mark.parametrize("folder", ["millgauge", "verification"])
def test_no_local_checkpoints_or_row_functions(folder):
    for path in (ROOT / folder).rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text and "F.udf(" not in text and ".rdd" not in text, path
