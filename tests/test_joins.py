"""Joins of rows laid out from few bytes (pixels, taps, variants, candidates): never a broadcast by file size."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")
NAMES = ["b03_plan_lookup", "c10_resize_bilinear", "c20_rotate_90_equals_turn", "c19_scan_jitter", "c20_perspective_quad", "c20_rotate_30", "d06_leader_clusters", "c10_resize_bicubic", "c10_resize_nearest"]


@pytest.mark.parametrize("name", NAMES)
def test_no_broadcast_by_file_size(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    # what a query has stored before may be joined with per-image aggregates only
    allowed = {"d06_leader_clusters": 2}.get(name, 0)
    assert "SortMergeJoin" in plan and plan.count("BroadcastExchange") <= allowed
