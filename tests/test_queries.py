"""Registered queries against their SQL, and plan checks."""
import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = ["newest_daily_scores", "calendar_fill", "panel_labels", "event_root_counts", "nearest_site", "alert_waves_batch", "post_tally",
          "segment_tails", "flight_legs", "gate_crossings", "heading_to_base", "location_and_dyad_sums", "aligned_histories", "smoothed_counts", "densest_newest_cells"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    msg, _, _, ok = compare(spark, duck(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, msg


@pytest.mark.parametrize("name", ["daily_score_history", "panel_labels", "as_of_state", "archive_cells", "location_and_dyad_sums", "composite_sensitivity"])
def test_plans_have_no_cross_product(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
