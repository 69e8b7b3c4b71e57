"""Plan checks: no cartesian / nested-loop joins, filters and pruning reach the scans."""

import os

import pytest

from upshot.plans import load_all
from upshot.plans.domain import Domain

SMOKE = "/root/testdata/sf0.001"
PLANNED = ["s3_engagement_panel", "c5_analysis_table", "e1_two_sample_ttest", "e8_organization_lift",
           "e9_type_lift_vs_control", "g5_growth_comparison", "e13_did", "a17_segment_rollup",
           "e7_direct_vs_attributed", "e12_ate_bootstrap", "e16_wilcoxon_prepost", "e5_mann_whitney_by_segment"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_cartesian_or_nested_loop(spark, name):
    if not os.path.exists(SMOKE):
        pytest.skip("no smoke data")
    plan = _plan(load_all()[name].build(spark, SMOKE))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_pushdown_and_pruning(spark):
    if not os.path.exists(SMOKE):
        pytest.skip("no smoke data")
    plan = _plan(Domain(spark, SMOKE).engagements())
    scan = [line for line in plan.split("\n") if "FileScan parquet" in line and "o_orderstatus" in line][0]
    assert "EqualTo(o_orderstatus,P)" in scan and "o_totalprice" not in scan
    li = [line for line in _plan(Domain(spark, SMOKE).panel()).split("\n")
          if "FileScan parquet" in line and "l_orderkey" in line]
    assert li and all("l_comment" not in x and "l_returnflag" not in x for x in li)


def test_panel_reads_lines_once_for_the_families(spark):
    """The panel as planned, before anything is written: no Expand, two reads of the
    line items (family revenue, type of the first direct engagement)."""
    if not os.path.exists(SMOKE):
        pytest.skip("no smoke data")
    plan = _plan(Domain(spark, SMOKE).panel())
    assert "Expand" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert sum("FileScan parquet" in line and "l_orderkey" in line for line in plan.split("\n")) == 2
