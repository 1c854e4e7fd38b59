"""Plan shape: pushed filters, no nested-loop joins, top-k limits."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

from habitlake.plans import registry

STREAMING = {"daily_rollup_stream", "vote_stream", "invite_notify_stream", "reset_redeem_stream", "streak_stream",
             "goal_stream", "reminder_stream", "append_logs", "admit_registrations"}
def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# a single-partition exchange only where a global top-n is the feature, or
# for global counts (one partial-aggregate row per task reaches it)
SINGLE_PARTITION_OK = {"suggestion_top10", "cascade_delete_users", "integrity_audit"}


@pytest.mark.parametrize("name", sorted(set(registry.builders()) - STREAMING))
def test_no_nested_loop_or_cartesian(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p, name
    if name not in SINGLE_PARTITION_OK:
        assert "SinglePartition" not in p, name


def test_day_filter_pushed_to_scan(spark):
    df = E.queries()["daily_points"](spark, SF_SMALL)
    p = plan(df)
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2024-01-15T00:00), LessThan(ts,2024-01-16T00:00)]" \
        in p or "GreaterThanOrEqual(ts,2024-01-15" in p


def test_recent_is_group_limited(spark):
    p = plan(E.queries()["recent_activities"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p


def test_column_pruning_on_logs(spark):
    p = plan(E.queries()["streaks"](spark, SF_SMALL))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in p


def test_log_date_partitions_pruned(spark, tmp_path):
    """Logs stored by S2 (partitioned by log_date): day and range queries
    read only the partitions they need."""
    from habitlake.operators import daily as D
    from habitlake.operators import reports as R
    from habitlake.sources.fixtures import Fixtures
    from habitlake.sources.sinks import append_logs
    path = str(tmp_path / "logs")
    append_logs(Fixtures(spark, SF_SMALL).user_activity_logs, path, "all")
    logs = spark.read.parquet(path)
    p1 = plan(D.daily_log_count(logs, Fixtures(spark, SF_SMALL).users, "2024-01-15"))
    assert "PartitionFilters: [isnotnull(log_date" in p1 and "2024-01-15" in p1
    p2 = plan(R.user_day_rollup(logs, "2024-01-08", "2024-01-22"))
    assert "PartitionFilters: [isnotnull(log_date" in p2 and "2024-01-22" in p2
    # same answers as the unpartitioned source
    a = sorted(tuple(r) for r in D.daily_log_count(logs, Fixtures(spark, SF_SMALL).users, "2024-01-15").collect())
    fx = Fixtures(spark, SF_SMALL)
    b = sorted(tuple(r) for r in D.daily_log_count(fx.user_activity_logs, fx.users, "2024-01-15").collect())
    assert a == b


@pytest.mark.parametrize("name", ["goal_transitions_range", "goal_reminders_range"])
def test_goal_range_reaches_the_scan(spark, name):
    scans = [x for x in plan(E.queries()[name](spark, SF_SMALL)).splitlines() if "FileScan" in x]
    assert scans and all("GreaterThanOrEqual(ts,2024-01-08T00:00)" in x and "LessThan(ts,2024-01-22T00:00)" in x for x in scans if "value" in x)
