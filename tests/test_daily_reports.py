"""Daily rollups, reports and streaks on hand-made rows."""

from helpers import ACTS, GOALS, LOGS, USERS, d, df, log, rows, ts

from habitlake.operators import daily as D
from habitlake.operators import reports as R
from habitlake.operators import streaks as S
from habitlake.plans import dashboard

DAY = "2024-01-15"


def _users(spark, ids):
    return df(spark, [(i, f"u{i}", f"u{i}@x", None) for i in ids], USERS)


def test_zero_points_and_null_activity(spark):
    logs = df(spark, [log(1, 1, 30, 0, "2024-01-15 10:00:00"),            # points 0: neither side
                      log(2, 1, 20, 5, "2024-01-15 11:00:00", act=10),
                      log(3, 1, 10, -2, "2024-01-15 12:00:00"),           # one-time log, NULL activity
                      log(4, 1, 99, 9, "2024-01-14 23:59:59")], LOGS)     # other day
    acts = df(spark, [(10, 1, "Reading", 4, "default")], ACTS)
    users = _users(spark, [1, 2])
    assert rows(D.daily_productive_time(logs, users, DAY), "user_id", "productive_time", "unproductive_time") == \
        [(1, 20, 10), (2, 0, 0)]
    assert rows(D.daily_logs(logs, acts, DAY), "id", "name") == [(1, None), (2, "Reading"), (3, None)]
    assert rows(D.daily_minutes(logs, users, DAY), "user_id", "total_minutes") == [(1, 60), (2, 0)]
    assert rows(D.daily_log_count(logs, users, DAY), "user_id", "daily_activity_count") == [(1, 3), (2, 0)]


def test_two_goals_a_day_latest_wins(spark):
    logs = df(spark, [log(1, 1, 30, 7, "2024-01-15 10:00:00")], LOGS)
    goals = df(spark, [(1, 1, d(DAY), 5, ts("2024-01-15 06:00:00"), "not completed"),
                       (2, 1, d(DAY), 9, ts("2024-01-15 08:00:00"), "not completed")], GOALS)
    out = D.daily_points(logs, goals, _users(spark, [1]), DAY)
    assert rows(out, "user_id", "total_points", "goal_points") == [(1, 7, 9)]


def test_recent_top3_newest_first(spark):
    logs = df(spark, [log(i, 1, i, i, f"2024-01-15 0{i}:00:00") for i in range(1, 6)], LOGS)
    acts = df(spark, [], ACTS)
    out = D.recent_activities(logs, acts, DAY, 3)
    assert rows(out, "rn", "duration") == [(1, 5), (2, 4), (3, 3)]


def test_report_fanout_and_best_day_tie(spark):
    logs = df(spark, [log(1, 1, 10, 4, "2024-01-09 10:00:00"), log(2, 1, 10, 4, "2024-01-10 10:00:00"),
                      log(3, 1, 10, -1, "2024-01-10 11:00:00"), log(4, 1, 10, 1, "2024-01-10 12:00:00")], LOGS)
    goals = df(spark, [(1, 1, d("2024-01-10"), 5, ts("2024-01-10 06:00:00"), "completed"),
                       (2, 1, d("2024-01-10"), 5, ts("2024-01-10 07:00:00"), "completed")], GOALS)
    r = R.user_day_rollup(logs, "2024-01-08", "2024-01-22")
    # both days score 4 points, the earlier one wins
    assert rows(R.best_day(r), "date", "total_points") == [(d("2024-01-09"), 4)]
    # two goals of one status count the day's points twice, as the reference does
    assert rows(R.productivity_days(r, goals, "2024-01-08", "2024-01-22"), "date", "status", "total_points") == \
        [(d("2024-01-09"), "no goal", 4), (d("2024-01-10"), "completed", 8)]
    users = df(spark, [(1, "a", "a@x", None), (2, "b", "b@x", None)], USERS)
    t = rows(R.points_total_avg(r, users), "user_id", "total_points", "average_points_per_day")
    assert t == [(1, 8, 4.0), (2, 0, 0.0)]
    assert rows(R.time_split(r, users), "user_id", "productive_time", "unproductive_time") == \
        [(1, 30, 10), (2, None, None)]
    rep = R.productivity_report(logs, goals, users, "2024-01-08", "2024-01-22")
    by_user = {x.user_id: x for x in rep.collect()}
    assert by_user[2].productivity_days == []
    assert len(by_user[1].productivity_days) == 2


def test_streak_across_month_end_and_decay(spark):
    days = ["2024-01-29", "2024-01-30", "2024-01-31", "2024-02-01", "2024-02-03"]
    logs = df(spark, [log(i, 1, 5, 1, f"{x} 09:00:00") for i, x in enumerate(days)], LOGS)
    st = S.streaks(logs, "2024-02-03")
    assert rows(st, "current_streak", "longest_streak", "last_logged_date") == [(1, 4, d("2024-02-03"))]
    rec = rows(S.streak_records(logs, "2024-02-03"), "date", "streak_count", "is_streak_record")
    assert rec[3] == (d("2024-02-01"), 4, True) and rec[4] == (d("2024-02-03"), 1, False)
    users = df(spark, [(1, "a", "a@x", None), (2, "b", "b@x", None)], USERS)
    status = {r.user_id: r for r in S.streak_status(st, users, "2024-02-05").collect()}
    assert status[1].current_streak == 0 and status[1].longest_streak == 4
    assert status[1].streak_message == S.MSG_AT_ZERO
    assert status[2].streak_message == S.MSG_WELCOME
    s4 = {r.user_id: r.streak_message for r in S.streak_status(st, users, "2024-02-04").collect()}
    assert s4[1] == S.MSG_ON_A_STREAK


def test_dashboard_nested(spark):
    logs = df(spark, [log(1, 1, 30, 5, "2024-01-15 10:00:00"), log(2, 1, 30, -5, "2024-01-15 11:00:00")], LOGS)
    out = dashboard.daily_dashboard(logs, df(spark, [], ACTS), df(spark, [], GOALS), _users(spark, [1, 2]), DAY)
    got = {r.user_id: r for r in out.collect()}
    assert got[1].daily_productive_time.productive_time == 30
    assert [x.points for x in got[1].recent_activities] == [-5, 5]
    assert got[2].recent_activities == [] and got[2].streak_message == S.MSG_WELCOME
    assert got[1].streak_message == S.MSG_ON_A_ROLL


def test_upsert_update_may_set_null(spark):
    state = df(spark, [(1, 3, 5, d("2024-01-10")), (2, 1, 1, d("2024-01-11"))], "user_id long, current_streak int, "
               "longest_streak int, last_logged_date date")
    upd = df(spark, [(1, 0, 5, None), (3, 1, 1, d("2024-01-12"))], "user_id long, current_streak int, "
             "longest_streak int, last_logged_date date")
    out = rows(S.upsert_streaks(state, upd), "user_id", "current_streak", "longest_streak", "last_logged_date")
    assert out == [(1, 0, 5, None), (2, 1, 1, d("2024-01-11")), (3, 1, 1, d("2024-01-12"))]
