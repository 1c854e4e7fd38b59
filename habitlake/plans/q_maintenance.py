"""Registered maintenance jobs (M1–M7): each returns the new table state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import maintenance as M
from ..sources.tables import APP_SCHEMAS
from .registry import register

_ACT_COLS = "id, user_id, name, points, activity_type"


@register("edit_catalog", """
WITH e AS (SELECT id, arg_max(name, seq) AS name, arg_max(points, seq) AS points FROM activity_changes
           WHERE op = 'U' GROUP BY id)
SELECT a.id, a.user_id, COALESCE(e.name, a.name) AS name, CASE WHEN e.id IS NULL THEN a.points ELSE e.points END AS points,
 CASE WHEN e.id IS NULL THEN a.activity_type ELSE 'custom' END AS activity_type
FROM user_activities a LEFT JOIN e ON e.id = a.id""", ("user_activities", "activity_changes"))
def _m1(fx):
    return M.edit_catalog(fx.user_activities, fx.activity_changes.where(F.col("op") == "U"))


# the activity everyone deletes
_DEL = "name = 'Watching adult websites'"


@register("delete_activities", f"SELECT {_ACT_COLS} FROM user_activities WHERE NOT ({_DEL})", ("user_activities",))
def _m2a(fx):
    ids = fx.user_activities.where(F.expr(_DEL)).select("id")
    return M.delete_activities(fx.user_activities, fx.user_activity_logs, ids)[0]


@register("delete_activities_logs", f"""
SELECT * FROM user_activity_logs WHERE activity_id IS NULL
 OR activity_id NOT IN (SELECT id FROM user_activities WHERE {_DEL})""", ("user_activities", "user_activity_logs"))
def _m2l(fx):
    ids = fx.user_activities.where(F.expr(_DEL)).select("id")
    return M.delete_activities(fx.user_activities, fx.user_activity_logs, ids)[1]


_M3_TABLES = ("users", "user_goals", "team_memberships", "team_invitations", "user_activities",
              "user_activity_logs", "teams", "password_reset", "team_user_roles", "team_activity_logs", "team_activity_requests")


def _m3_tables(fx):
    return {t: fx[t] for t in _M3_TABLES}


@register("cascade_delete_users", """
WITH req AS (SELECT c_custkey AS uid FROM customer WHERE c_acctbal < 0),
blk AS (SELECT uid FROM req WHERE uid IN (SELECT created_by FROM teams) OR uid IN (SELECT user_id FROM password_reset)
  OR uid IN (SELECT user_id FROM user_activities) OR uid IN (SELECT user_id FROM team_activity_logs)
  OR uid IN (SELECT user_id FROM team_activity_requests)),
gone AS (SELECT uid FROM req WHERE uid NOT IN (SELECT uid FROM blk)),
gm AS (SELECT id FROM team_memberships WHERE user_id IN (SELECT uid FROM gone))
SELECT 'blocked' AS table_name, COUNT(*) AS n_rows FROM blk
UNION ALL SELECT 'users', COUNT(*) FROM users WHERE id NOT IN (SELECT uid FROM gone)
UNION ALL SELECT 'user_goals', COUNT(*) FROM user_goals WHERE user_id NOT IN (SELECT uid FROM gone)
UNION ALL SELECT 'team_memberships', COUNT(*) FROM team_memberships WHERE user_id NOT IN (SELECT uid FROM gone)
UNION ALL SELECT 'team_invitations', COUNT(*) FROM team_invitations
  WHERE sender_id NOT IN (SELECT uid FROM gone) AND recipient_id NOT IN (SELECT uid FROM gone)
UNION ALL SELECT 'user_activities', COUNT(*) FROM user_activities
UNION ALL SELECT 'user_activity_logs', COUNT(*) FROM user_activity_logs WHERE user_id NOT IN (SELECT uid FROM gone)
UNION ALL SELECT 'teams', COUNT(*) FROM teams
UNION ALL SELECT 'password_reset', COUNT(*) FROM password_reset
UNION ALL SELECT 'team_activity_logs', COUNT(*) FROM team_activity_logs
UNION ALL SELECT 'team_activity_requests', COUNT(*) FROM team_activity_requests
UNION ALL SELECT 'team_user_roles', COUNT(*) FROM team_user_roles WHERE team_membership_id NOT IN (SELECT id FROM gm)""",
          _M3_TABLES)
def _m3(fx):
    req = fx.customer.where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("id"))
    out = M.cascade_delete_users(_m3_tables(fx), req)
    parts = [out[t].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
             for t in ["blocked", *_M3_TABLES]]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


_AUDITED = ("user_activities", "user_activity_logs", "user_goals", "teams", "team_memberships", "team_roles", "team_user_roles",
            "team_activities", "team_invitations", "team_activity_logs", "team_activity_requests", "password_reset", "suggestions")


def _audit_tables(fx):
    # registrations stand in for the users table, so unique rules have hits
    return {"users": fx.registrations.withColumn("google_id", F.lit(None).cast("string")), **{t: fx[t] for t in _AUDITED}}


def _rule_sql(table, rule, kind, cols, parent):
    """One query per rule."""
    keys = ", ".join(cols)
    given = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    head = f"SELECT '{table}' AS \"table\", '{rule}' AS rule, CAST"
    if kind == "unique":
        return f"{head}(count(*) FILTER (WHERE {given}) - count(DISTINCT CASE WHEN {given} THEN ({keys}) END) AS BIGINT) AS violations FROM {table}"
    if kind == "null":
        return f"{head}(count(*) - count({keys}) AS BIGINT) FROM {table}"
    key = M.CONSTRAINTS[parent][0][0][0]
    return f"{head}(count(*) AS BIGINT) FROM (SELECT {keys} FROM {table} WHERE {given}) c ANTI JOIN {parent} p ON p.{key} = c.{keys}"


_COLUMNS = {t: APP_SCHEMAS[t].names for t in _AUDITED} | {"users": ["id", "username", "email", "google_id"]}


@register("integrity_audit", "WITH users AS (SELECT id, username, email, CAST(NULL AS VARCHAR) AS google_id FROM registrations)\n"
          + "\nUNION ALL ".join(_rule_sql(*r) for r in M.audit_rules(_COLUMNS)), ("registrations", *_AUDITED))
def _m4(fx):
    return M.integrity_audit(_audit_tables(fx))


@register("rescore_catalog", f"""
WITH rates AS (SELECT name, points * 2 AS points FROM activity_rates WHERE points > 0)
SELECT a.id, a.user_id, a.name, COALESCE(r.points, a.points) AS points, a.activity_type
FROM user_activities a LEFT JOIN rates r ON r.name = a.name""", ("user_activities", "activity_rates"))
def _m5(fx):
    rates = fx.activity_rates.where(F.col("points") > 0).select("name", (F.col("points") * 2).alias("points"))
    return M.rescore_catalog(fx.user_activities, rates)


@register("remap_keys", """
WITH mp AS (SELECT id AS old_id, id + 1000000 AS new_id FROM users WHERE google_id IS NOT NULL)
SELECT l.id, COALESCE(mp.new_id, l.user_id) AS user_id, l.activity_id, l.duration, l.points,
 l.activity_description, l.logged_at
FROM user_activity_logs l LEFT JOIN mp ON mp.old_id = l.user_id""", ("users", "user_activity_logs"))
def _m6(fx):
    mp = fx.users.where(F.col("google_id").isNotNull()).select(
        F.col("id").alias("old_id"), (F.col("id") + 1_000_000).alias("new_id"))
    return M.remap_keys(fx.user_activity_logs, mp, ["user_id"])


@register("compact_changes", """
WITH allr AS (SELECT id, user_id, name, points, 'I' AS op, -4611686018427387904 AS s FROM user_activities
  UNION ALL SELECT id, user_id, name, points, op, seq FROM activity_changes),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC) AS rn FROM allr) WHERE rn = 1)
SELECT id, user_id, name, points FROM latest WHERE op <> 'D'""", ("user_activities", "activity_changes"))
def _m7(fx):
    return M.compact_changes(fx.user_activities, fx.activity_changes, "id", "seq", ["user_id", "name", "points"])
