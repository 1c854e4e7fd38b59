"""Registered range reports (R1–R5) for ``[START, END)``."""

from __future__ import annotations

from ..operators import reports as R
from .registry import END, START, register

_RANGE = f"logged_at >= TIMESTAMP '{START}' AND logged_at < TIMESTAMP '{END}'"
_PPD = f"""ppd AS (SELECT user_id, date, sum(points) AS total_points
 FROM (SELECT user_id, points, CAST(logged_at AS DATE) AS date FROM user_activity_logs WHERE {_RANGE}) GROUP BY ALL)"""
# plain sums over the range and the number of different days
_R1 = f"""SELECT u.id AS user_id, CAST(COALESCE(total, 0) AS BIGINT) AS total_points,
 CASE WHEN n_days > 0 THEN round(total / n_days, 2) ELSE 0.0 END AS average_points_per_day
FROM users u LEFT JOIN (SELECT user_id, CAST(sum(points) AS DOUBLE) AS total, count(DISTINCT CAST(logged_at AS DATE)) AS n_days
 FROM user_activity_logs WHERE {_RANGE} GROUP BY user_id) s ON s.user_id = u.id"""
_R2 = """SELECT user_id, date, CAST(total_points AS BIGINT) AS total_points FROM (
 SELECT user_id, date, total_points, row_number() OVER (PARTITION BY user_id ORDER BY total_points DESC, date) AS rn
 FROM ppd) WHERE rn = 1"""
# the day's points once for each of its goals, by status; days without goals beside them
_R3 = """SELECT user_id, date, status, CAST(sum(total_points * n) AS BIGINT) AS total_points FROM (
  SELECT p.user_id, p.date, p.total_points, g.status, g.n FROM ppd p JOIN (
    SELECT user_id, CAST(created_at AS DATE) AS date, ifnull(status, 'no goal') AS status, count(*) AS n FROM user_goals GROUP BY ALL) g
    USING (user_id, date)
  UNION ALL
  SELECT user_id, date, total_points, 'no goal', 1 FROM ppd
  WHERE (user_id, date) NOT IN (SELECT (user_id, CAST(created_at AS DATE)) FROM user_goals))
GROUP BY user_id, date, status"""
_R4 = f"""SELECT u.id AS user_id, t.productive_time, t.unproductive_time FROM users u LEFT JOIN (
 SELECT user_id, CAST(sum(duration * CAST(points > 0 AS INTEGER)) AS BIGINT) AS productive_time,
  CAST(sum(duration * CAST(points < 0 AS INTEGER)) AS BIGINT) AS unproductive_time
 FROM user_activity_logs WHERE {_RANGE} GROUP BY user_id) t ON t.user_id = u.id"""
_LOGS = ("users", "user_activity_logs")


def _rollup(fx):
    return R.user_day_rollup(fx.user_activity_logs, START, END)


@register("points_total_avg", _R1, _LOGS)
def _r1(fx):
    return R.points_total_avg(_rollup(fx), fx.users)


@register("best_day", f"WITH {_PPD}\n{_R2}", _LOGS)
def _r2(fx):
    return R.best_day(_rollup(fx))


@register("productivity_days", f"WITH {_PPD}\n{_R3}", _LOGS + ("user_goals",))
def _r3(fx):
    return R.productivity_days(_rollup(fx), fx.user_goals, START, END)


@register("time_split", _R4, _LOGS)
def _r4(fx):
    return R.time_split(_rollup(fx), fx.users)


@register("productivity_report", f"""
WITH {_PPD}, r1 AS ({_R1}), r2 AS ({_R2}), r3 AS ({_R3}), r4 AS ({_R4}),
r3u AS (SELECT user_id, CAST(COUNT(*) AS INTEGER) AS n_days, CAST(SUM(total_points) AS BIGINT) AS days_points
        FROM r3 GROUP BY user_id)
SELECT r1.user_id, r1.total_points, r1.average_points_per_day, r2.date AS best_date, r2.total_points AS best_points,
 COALESCE(r3u.n_days, 0) AS n_days, COALESCE(r3u.days_points, 0) AS days_points,
 r4.productive_time, r4.unproductive_time
FROM r1 LEFT JOIN r2 ON r2.user_id = r1.user_id LEFT JOIN r3u ON r3u.user_id = r1.user_id
LEFT JOIN r4 ON r4.user_id = r1.user_id""", _LOGS + ("user_goals",))
def _r5(fx):
    return R.flat_report(R.productivity_report(fx.user_activity_logs, fx.user_goals, fx.users, START, END))
