"""Registered goal queries."""

from __future__ import annotations

from ..operators import goals as G
from .registry import END, START, register

# valid when DuckDB reads it as a time with an offset; the date is the one written
_GOAL_TS = ("try_strptime(regexp_replace(replace(goal_date, 'Z', '+00:00'), '[.,][0-9]+', ''), '%Y-%m-%dT%H:%M:%S%z')")


@register("set_goals", f"""
SELECT id, user_id, CAST(left(goal_date, 10) AS DATE) AS goal_date, CAST(goal_points AS INTEGER) AS goal_points,
 requested_at AS created_at, 'not completed' AS status
FROM goal_requests WHERE {_GOAL_TS} IS NOT NULL""", ("goal_requests",))
def _g1(fx):
    return G.set_goals(fx.goal_requests)[0]


@register("set_goals_rejects", f"""
SELECT id, user_id, goal_date, 'invalid goal_date' AS reason FROM goal_requests WHERE {_GOAL_TS} IS NULL""",
          ("goal_requests",))
def _g1r(fx):
    return G.set_goals(fx.goal_requests)[1]


# day goal: latest goal's points, first creation time
_DG = """dg AS (SELECT user_id, CAST(created_at AS DATE) AS date, MIN(created_at) AS goal_at FROM user_goals
   GROUP BY user_id, CAST(created_at AS DATE)),
dg2 AS (SELECT g.user_id, g.date, g.goal_points, d.goal_at FROM (
   SELECT user_id, CAST(created_at AS DATE) AS date, goal_points,
    row_number() OVER (PARTITION BY user_id, CAST(created_at AS DATE) ORDER BY created_at DESC, id DESC) AS rn
   FROM user_goals) g JOIN dg d ON d.user_id = g.user_id AND d.date = g.date WHERE g.rn = 1)"""
_RUN = """run AS (SELECT id, user_id, CAST(logged_at AS DATE) AS date, logged_at, points,
   SUM(points) OVER (PARTITION BY user_id, CAST(logged_at AS DATE) ORDER BY logged_at, id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after
   FROM user_activity_logs)"""


def _flips(done: str, undone: str) -> str:
    return f"""flips AS (SELECT r.user_id, r.date, r.id, r.logged_at,
   CASE WHEN {done} THEN 'completed' WHEN {undone} THEN 'uncompleted' END AS transition
  FROM run r JOIN dg2 g ON g.user_id = r.user_id AND g.date = r.date
  WHERE g.goal_points > 0 AND r.logged_at >= g.goal_at)"""


_REF = _flips("r.after + r.points > g.goal_points AND NOT r.after > g.goal_points",
              "g.goal_points > r.after + r.points AND r.after > g.goal_points")
_INT = _flips("r.after > g.goal_points AND r.after - r.points <= g.goal_points",
              "r.after < g.goal_points AND r.after - r.points > g.goal_points")
_V = ("user_activity_logs", "user_goals")


_G2_SQL = f"""
WITH {_DG}, {_RUN}, {_REF}
SELECT user_id, date, id, logged_at, transition FROM flips WHERE transition IS NOT NULL"""


@register("goal_transitions", _G2_SQL, _V)
def _g2(fx):
    return G.goal_transitions(fx.user_activity_logs, fx.user_goals, "reference")


@register("goal_transitions_intent", f"""
WITH {_DG}, {_RUN}, {_INT}
SELECT user_id, date, id, logged_at, transition FROM flips WHERE transition IS NOT NULL""", _V)
def _g2i(fx):
    return G.goal_transitions(fx.user_activity_logs, fx.user_goals, "intent")


@register("goal_status", f"""
WITH {_DG}, {_RUN}, {_REF},
last AS (SELECT user_id, date, transition FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date
          ORDER BY logged_at DESC, id DESC) AS rn FROM flips WHERE transition IS NOT NULL) WHERE rn = 1)
SELECT g.id AS goal_id, g.user_id, CAST(g.created_at AS DATE) AS date,
 CASE l.transition WHEN 'completed' THEN 'completed' WHEN 'uncompleted' THEN 'not completed' ELSE g.status END AS status
FROM user_goals g LEFT JOIN last l ON l.user_id = g.user_id AND l.date = CAST(g.created_at AS DATE)""", _V)
def _g3(fx):
    t = G.goal_transitions(fx.user_activity_logs, fx.user_goals, "reference")
    return G.goal_status(fx.user_goals, t)


_G4_SQL = f"""
WITH {_DG}, {_RUN}, {_REF},
ev AS (SELECT user_id, CAST(created_at AS DATE) AS date, created_at AS at_ts, 1 AS is_start FROM user_goals
       UNION ALL SELECT user_id, date, logged_at, 1 FROM flips WHERE transition = 'uncompleted'
       UNION ALL SELECT user_id, date, logged_at, 0 FROM flips WHERE transition = 'completed'),
trk AS (SELECT user_id, date, at_ts, COALESCE(lead(at_ts) OVER (PARTITION BY user_id, date ORDER BY at_ts, is_start),
               CAST(date + 1 AS TIMESTAMP)) AS e, is_start FROM ev),
ticks AS (SELECT user_id, date, e, unnest(generate_series(at_ts + INTERVAL 3 HOUR, e, INTERVAL 3 HOUR)) AS tick
          FROM trk WHERE is_start = 1 AND at_ts + INTERVAL 3 HOUR < e)
SELECT t.user_id, t.tick AS tick_at,
 CAST(COALESCE((SELECT SUM(l.points) FROM user_activity_logs l WHERE l.user_id = t.user_id
   AND CAST(l.logged_at AS DATE) = t.date AND l.logged_at <= t.tick), 0) AS BIGINT) AS total_points,
 COALESCE(g.goal_points, 0) AS goal_points
FROM ticks t LEFT JOIN dg2 g ON g.user_id = t.user_id AND g.date = t.date
WHERE t.tick < t.e"""


@register("goal_reminders", _G4_SQL, _V)
def _g4(fx):
    t = G.goal_transitions(fx.user_activity_logs, fx.user_goals, "reference")
    return G.goal_reminders(fx.user_goals, t, fx.user_activity_logs)


@register("goal_transitions_range", f"SELECT * FROM ({_G2_SQL}) WHERE date >= DATE '{START}' AND date < DATE '{END}'", _V)
def _g2r(fx):
    return G.goal_transitions(fx.user_activity_logs, fx.user_goals, "reference", start=START, end=END)


@register("goal_reminders_range", f"SELECT * FROM ({_G4_SQL}) WHERE tick_at >= TIMESTAMP '{START}' AND tick_at < TIMESTAMP '{END}'", _V)
def _g4r(fx):
    t = G.goal_transitions(fx.user_activity_logs, fx.user_goals, "reference", start=START, end=END)
    return G.goal_reminders(fx.user_goals, t, fx.user_activity_logs, start=START, end=END)
