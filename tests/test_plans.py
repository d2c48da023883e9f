"""No registered query may join its rows pairwise; scans stay pruned."""

import pytest

from cuemill.plans import all_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_no_pairwise_join(spark, name):
    plan = all_queries()[name].build(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_scan_is_pruned(spark):
    plan = all_queries()["c3_interval_overlap"].build(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan
