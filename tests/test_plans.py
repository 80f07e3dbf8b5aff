"""Scale guards on physical plans (the checks behind PLANS.md)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from qoeflow.plans.catalog import REGISTRY  # noqa: E402
from fixtures_data import SF_SMALL  # noqa: E402
from plan_report import summarise  # noqa: E402

STREAMING = {"stream_state", "stream_state_lazy", "stream_state_timed", "stream_slots", "ingest_routing",
             "topic_roundtrip", "multi_sink_counts", "late_rows", "exchange_fanout_stream",
             "group_table_stream", "latest_decision_stream", "sliding_stream", "decision_loop_stream",
             "assign_stream", "ingest_decide_stream", "decision_loop_eg_stream", "decision_loop_custom_stream",
             "exchange_forward_stream", "epsilon_lines_stream", "stream_rejects", "newest_update_stream",
             "assign_asof_stream", "stream_state_chained", "stream_state_bootstrap", "expiring_fanout_stream",
             "run_metrics", "state_policy_stream"}
BATCH = sorted(set(REGISTRY) - STREAMING)


def _plan(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cartesian_nested_loop_or_row_udf(spark, name):
    c, _ = summarise(_plan(spark, name))
    assert c["cartesian"] == 0 and c["BNLJ"] == 0, name
    assert c["row-udf"] == 0, name


def test_flagship_plan_shape(spark):
    plan = _plan(spark, "ucb_slots")
    c, scans = summarise(plan)
    # partial aggregate -> (group, decision, tick) shuffle -> (group, block of ticks) shuffle
    # -> group shuffle of a row per (group, decision, block); nothing else
    assert c["hash shuffle"] == 3 and c["single-partition"] == 0 and c["range shuffle"] == 0
    assert "partial_sum" in plan
    # the scan reads only the four columns it needs
    assert all("props" not in s and "event_id" not in s for s in scans)
