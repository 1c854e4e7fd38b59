"""Registered streak queries (F1–F4) and the daily dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import streaks as S
from . import dashboard
from .registry import AS_OF, register, sql_str

_DAYS = f"""
streak_days AS (SELECT DISTINCT user_id, CAST(logged_at AS DATE) AS day FROM user_activity_logs
                WHERE CAST(logged_at AS DATE) <= DATE '{AS_OF}'),
streak_isl AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island
               FROM streak_days),
streak_runs AS (SELECT user_id, island, CAST(COUNT(*) AS INTEGER) AS len, MAX(day) AS e FROM streak_isl GROUP BY user_id, island),
streak_state AS (SELECT user_id, CAST(arg_max(len, e) AS INTEGER) AS current_streak, MAX(len) AS longest_streak,
                 MAX(e) AS last_logged_date FROM streak_runs GROUP BY user_id)"""


@register("streaks", f"""
WITH {_DAYS}
SELECT user_id, current_streak, longest_streak, last_logged_date FROM streak_state""",
          ("user_activity_logs",))
def _f1(fx):
    return S.streaks(fx.user_activity_logs, AS_OF)


@register("streak_records", f"""
WITH {_DAYS},
counts AS (SELECT user_id, day, CAST(row_number() OVER (PARTITION BY user_id, island ORDER BY day) AS INTEGER) AS streak_count
           FROM streak_isl)
SELECT user_id, day AS date, streak_count,
 streak_count > COALESCE(MAX(streak_count) OVER (PARTITION BY user_id ORDER BY day
                                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS is_streak_record
FROM counts""", ("user_activity_logs",))
def _f2(fx):
    return S.streak_records(fx.user_activity_logs, AS_OF)


_STATUS = f"""
SELECT u.id AS user_id,
 CAST(CASE WHEN s.user_id IS NULL OR s.last_logged_date IS NULL OR s.last_logged_date < DATE '{AS_OF}' - 1 THEN 0
      ELSE s.current_streak END AS INTEGER) AS current_streak,
 CAST(COALESCE(s.longest_streak, 0) AS INTEGER) AS longest_streak,
 CASE WHEN s.user_id IS NULL THEN {sql_str(S.MSG_WELCOME)}
      WHEN s.last_logged_date IS NULL OR s.last_logged_date < DATE '{AS_OF}' - 1 THEN {sql_str(S.MSG_AT_ZERO)}
      WHEN s.last_logged_date = DATE '{AS_OF}' THEN {sql_str(S.MSG_ON_A_ROLL)}
      WHEN s.last_logged_date = DATE '{AS_OF}' - 1 THEN {sql_str(S.MSG_ON_A_STREAK)}
      ELSE '' END AS streak_message
FROM users u LEFT JOIN streak_state s ON s.user_id = u.id"""


@register("streak_status", f"WITH {_DAYS}\n{_STATUS}", ("users", "user_activity_logs"))
def _f3(fx):
    return S.streak_status(S.streaks(fx.user_activity_logs, AS_OF), fx.users, AS_OF)


_STALE = 7  # days without a log after which a streak row is reset


@register("upsert_streaks", f"""
WITH {_DAYS},
prev_days AS (SELECT * FROM streak_days WHERE day <= DATE '{AS_OF}' - 1),
prev_isl AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island
             FROM prev_days),
prev_runs AS (SELECT user_id, island, CAST(COUNT(*) AS INTEGER) AS len, MAX(day) AS e FROM prev_isl GROUP BY user_id, island),
old_state AS (SELECT user_id, CAST(arg_max(len, e) AS INTEGER) AS current_streak, MAX(len) AS longest_streak,
              MAX(e) AS last_logged_date FROM prev_runs GROUP BY user_id),
upd AS (SELECT user_id, current_streak, longest_streak, last_logged_date FROM streak_state
        WHERE last_logged_date = DATE '{AS_OF}'
        UNION ALL SELECT user_id, 0, longest_streak, NULL FROM old_state
        WHERE last_logged_date < DATE '{AS_OF}' - {_STALE}
        UNION ALL SELECT id, 0, 0, NULL FROM users WHERE id NOT IN (SELECT user_id FROM streak_state))
SELECT COALESCE(u.user_id, o.user_id) AS user_id,
 CASE WHEN u.user_id IS NOT NULL THEN u.current_streak ELSE o.current_streak END AS current_streak,
 CASE WHEN u.user_id IS NOT NULL THEN u.longest_streak ELSE o.longest_streak END AS longest_streak,
 CASE WHEN u.user_id IS NOT NULL THEN u.last_logged_date ELSE o.last_logged_date END AS last_logged_date
FROM old_state o FULL OUTER JOIN upd u ON u.user_id = o.user_id""", ("users", "user_activity_logs"))
def _f4(fx):
    """Old state = streaks up to the day before; updates = today's state of
    users who logged today, a reset (current 0, last date NULL) of streaks
    idle for more than a week, and a zero row for users never seen."""
    import datetime as dt
    logs = fx.user_activity_logs
    day = dt.date.fromisoformat(AS_OF)
    prev = S.streaks(logs, day - dt.timedelta(days=1))
    today = S.streaks(logs, day)
    cols = ["user_id", "current_streak", "longest_streak", "last_logged_date"]
    upd = (today.where(F.col("last_logged_date") == F.lit(day)).select(*cols)
           .unionByName(prev.where(F.col("last_logged_date") < F.lit(day - dt.timedelta(days=_STALE)))
                        .select("user_id", F.lit(0).alias("current_streak"), "longest_streak",
                                F.lit(None).cast("date").alias("last_logged_date")))
           .unionByName(fx.users.join(today, fx.users.id == today.user_id, "left_anti")
                        .select(F.col("id").alias("user_id"), F.lit(0).alias("current_streak"),
                                F.lit(0).alias("longest_streak"), F.lit(None).cast("date").alias("last_logged_date"))))
    return S.upsert_streaks(prev, upd)


@register("daily_dashboard", f"""
WITH {_DAYS},
st AS ({_STATUS}),
r AS (SELECT user_id, SUM(points) AS p, SUM(CASE WHEN points > 0 THEN duration ELSE 0 END) AS pt,
       SUM(CASE WHEN points < 0 THEN duration ELSE 0 END) AS ut, COUNT(*) AS n
      FROM user_activity_logs WHERE CAST(logged_at AS DATE) = DATE '{AS_OF}' GROUP BY user_id),
g AS (SELECT user_id, goal_points FROM (SELECT user_id, goal_points,
        row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn
      FROM user_goals WHERE CAST(created_at AS DATE) = DATE '{AS_OF}') WHERE rn = 1),
rc AS (SELECT user_id, CAST(COUNT(*) AS INTEGER) AS n_recent, CAST(SUM(points) AS INTEGER) AS recent_points FROM (
        SELECT user_id, points, row_number() OVER (PARTITION BY user_id ORDER BY logged_at DESC, id DESC) AS rn
        FROM user_activity_logs WHERE CAST(logged_at AS DATE) = DATE '{AS_OF}') WHERE rn <= 3 GROUP BY user_id)
SELECT st.user_id, CAST(COALESCE(r.p, 0) AS INTEGER) AS total_points, CAST(COALESCE(g.goal_points, 0) AS INTEGER) AS goal_points,
 CAST(COALESCE(r.pt, 0) AS INTEGER) AS productive_time, CAST(COALESCE(r.ut, 0) AS INTEGER) AS unproductive_time,
 COALESCE(rc.n_recent, 0) AS n_recent, COALESCE(rc.recent_points, 0) AS recent_points,
 COALESCE(r.n, 0) AS daily_activity_logs_count, st.current_streak, st.longest_streak, st.streak_message
FROM st LEFT JOIN r ON r.user_id = st.user_id LEFT JOIN g ON g.user_id = st.user_id LEFT JOIN rc ON rc.user_id = st.user_id""",
          ("users", "user_activity_logs", "user_goals"))
def _d7(fx):
    return dashboard.flat_dashboard(dashboard.daily_dashboard(
        fx.user_activity_logs, fx.user_activities, fx.user_goals, fx.users, AS_OF))
