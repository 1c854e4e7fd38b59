"""Registered daily queries (D1–D9) for ``as_of`` = AS_OF."""

from __future__ import annotations

from ..operators import daily as D
from .registry import AS_OF, register

_DAY = f"CAST(logged_at AS DATE) = DATE '{AS_OF}'"


@register("daily_logs", f"""
SELECT l.id, l.user_id, l.activity_id, ua.name, l.duration, l.points, l.activity_description
FROM user_activity_logs l LEFT JOIN user_activities ua ON ua.id = l.activity_id
WHERE CAST(l.logged_at AS DATE) = DATE '{AS_OF}'""", ("user_activity_logs", "user_activities"))
def _d1(fx):
    return D.daily_logs(fx.user_activity_logs, fx.user_activities, AS_OF)


@register("daily_points", f"""
WITH earned AS (SELECT user_id, sum(points) AS p FROM user_activity_logs WHERE {_DAY} GROUP BY user_id),
aimed AS (SELECT user_id, goal_points FROM user_goals WHERE CAST(created_at AS DATE) = DATE '{AS_OF}'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) = 1)
SELECT u.id AS user_id, CAST(ifnull(earned.p, 0) AS INTEGER) AS total_points,
 CAST(ifnull(aimed.goal_points, 0) AS INTEGER) AS goal_points
FROM users u LEFT JOIN earned ON earned.user_id = u.id LEFT JOIN aimed ON aimed.user_id = u.id""", ("users", "user_activity_logs", "user_goals"))
def _d2(fx):
    return D.daily_points(fx.user_activity_logs, fx.user_goals, fx.users, AS_OF)


@register("daily_productive_time", f"""
WITH d AS (SELECT user_id, duration, sign(points) AS s FROM user_activity_logs WHERE {_DAY})
SELECT u.id AS user_id, CAST(ifnull(sum(d.duration) FILTER (WHERE s = 1), 0) AS INTEGER) AS productive_time,
 CAST(ifnull(sum(d.duration) FILTER (WHERE s = -1), 0) AS INTEGER) AS unproductive_time
FROM users u LEFT JOIN d ON d.user_id = u.id GROUP BY u.id""", ("users", "user_activity_logs"))
def _d3(fx):
    return D.daily_productive_time(fx.user_activity_logs, fx.users, AS_OF)


@register("recent_activities", f"""
SELECT l.user_id, CAST(l.rn AS INTEGER) AS rn, l.duration, l.points, l.activity_description, ua.name
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY logged_at DESC, id DESC) AS rn
      FROM user_activity_logs WHERE {_DAY}) l
LEFT JOIN user_activities ua ON ua.id = l.activity_id
WHERE l.rn <= 3""", ("user_activity_logs", "user_activities"))
def _d4(fx):
    return D.recent_activities(fx.user_activity_logs, fx.user_activities, AS_OF, 3)


@register("daily_log_count", f"""
SELECT u.id AS user_id, (SELECT COUNT(*) FROM user_activity_logs l WHERE l.user_id = u.id AND {_DAY}) AS daily_activity_count
FROM users u""", ("users", "user_activity_logs"))
def _d5(fx):
    return D.daily_log_count(fx.user_activity_logs, fx.users, AS_OF)


@register("daily_minutes", f"""
SELECT u.id AS user_id,
 CAST(COALESCE((SELECT SUM(l.duration) FROM user_activity_logs l WHERE l.user_id = u.id AND {_DAY}), 0) AS BIGINT) AS total_minutes
FROM users u""", ("users", "user_activity_logs"))
def _d6(fx):
    return D.daily_minutes(fx.user_activity_logs, fx.users, AS_OF)


@register("activity_catalog", """
SELECT user_id, id, name, points, activity_type,
 CAST(row_number() OVER (PARTITION BY user_id ORDER BY points DESC, id) AS INTEGER) AS pos
FROM user_activities""", ("user_activities",))
def _d8(fx):
    return D.activity_catalog(fx.user_activities)


@register("activity_has_logs", """
SELECT ua.user_id, ua.id AS activity_id,
 EXISTS (SELECT 1 FROM user_activity_logs l WHERE l.user_id = ua.user_id AND l.activity_id = ua.id) AS log_exists
FROM user_activities ua""", ("user_activities", "user_activity_logs"))
def _d9(fx):
    pairs = fx.user_activities.selectExpr("user_id", "id AS activity_id")
    return D.activity_has_logs(pairs, fx.user_activity_logs)
