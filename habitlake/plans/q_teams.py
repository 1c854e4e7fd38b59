"""Registered team, invitation, user and feedback queries (T, V, U, B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import new_id_sql
from ..operators import feedback as B
from ..operators import invitations as V
from ..operators import teams as T
from ..operators import users as U
from .registry import AS_OF, register

_TM = ("team_memberships", "team_user_roles", "team_roles")


def _t(fx):
    return fx.team_memberships, fx.team_user_roles, fx.team_roles


# memberships that hold the owner role
_OWNERS = """owners AS (SELECT team_membership_id AS held_by FROM team_user_roles
  WHERE role_id IN (SELECT id FROM team_roles WHERE role_name = 'owner'))"""


@register("user_teams", f"""
WITH {_OWNERS}
SELECT m.user_id, m.team_id, (SELECT name FROM teams WHERE teams.id = m.team_id) AS name,
 CAST(m.id IN (SELECT held_by FROM owners) AS INTEGER) AS is_owner
FROM team_memberships m WHERE m.team_id IN (SELECT id FROM teams)""", _TM + ("teams",))
def _t1(fx):
    m, tur, r = _t(fx)
    return T.user_teams(m, fx.teams, tur, r)


@register("team_info", """
SELECT t.id, t.name, t.team_industry, t.team_size, t.is_private, t.created_by
FROM teams t WHERE t.id IN (SELECT team_id FROM pairs)""", ("teams", "pairs"))
def _t2(fx):
    return T.team_info(fx.pairs, fx.teams)


@register("team_activities_list", """
SELECT team_id, activity_name, points, array_to_string(activity_roles, ',') AS roles
FROM team_activities WHERE team_id IN (SELECT team_id FROM pairs)""", ("team_activities", "pairs"))
def _t3(fx):
    return T.team_activities_list(fx.pairs, fx.team_activities).select(
        "team_id", "activity_name", "points", F.array_join("activity_roles", ",").alias("roles"))


@register("team_roles_list", """
SELECT team_id, id, role_name FROM team_roles
WHERE team_id IN (SELECT team_id FROM pairs) AND role_name <> 'owner'""", ("team_roles", "pairs"))
def _t4(fx):
    return T.team_roles_list(fx.pairs, fx.team_roles, include_owner=False)


@register("team_roles_list_all", """
SELECT team_id, id, role_name FROM team_roles WHERE team_id IN (SELECT team_id FROM pairs)""",
          ("team_roles", "pairs"))
def _t4a(fx):
    return T.team_roles_list(fx.pairs, fx.team_roles, include_owner=True)


@register("is_team_owner", f"""
WITH {_OWNERS}
SELECT user_id, team_id, id IN (SELECT held_by FROM owners) AS is_owner
FROM team_memberships WHERE (user_id, team_id) IN (SELECT (user_id, team_id) FROM pairs)""", _TM + ("pairs",))
def _t5(fx):
    m, tur, r = _t(fx)
    return T.is_team_owner(fx.pairs, m, tur, r)


@register("visible_team_activities", """
WITH held AS (
 SELECT m.user_id, m.team_id, r.role_name
 FROM team_user_roles a, team_memberships m, team_roles r
 WHERE a.team_membership_id = m.id AND a.role_id = r.id AND (m.user_id, m.team_id) IN (SELECT (user_id, team_id) FROM pairs)),
wanted AS (SELECT id, team_id, unnest(activity_roles) AS role_name FROM team_activities),
seen AS (
 SELECT user_id, held.team_id, id FROM held JOIN wanted USING (team_id, role_name)
 UNION
 SELECT held.user_id, held.team_id, a.id FROM held JOIN team_activities a USING (team_id) WHERE role_name = 'owner')
SELECT user_id, seen.team_id, id, a.activity_name, a.points, a.created_at, a.updated_at
FROM seen JOIN team_activities a USING (id)""",
          _TM + ("pairs", "team_activities"))
def _t6(fx):
    m, tur, r = _t(fx)
    return T.visible_team_activities(fx.pairs, m, tur, r, fx.team_activities)


@register("team_members", """
WITH names AS (
 SELECT a.team_membership_id AS id, list(r.role_name ORDER BY r.role_name) AS held
 FROM team_user_roles a, team_roles r WHERE r.id = a.role_id GROUP BY a.team_membership_id)
SELECT m.team_id, t.created_by AS caller_id, m.id, (SELECT username FROM users WHERE users.id = m.user_id) AS username,
 array_to_string(COALESCE((SELECT held FROM names WHERE names.id = m.id), []), ', ') AS roles
FROM team_memberships m, teams t
WHERE t.id = m.team_id AND NOT t.created_by = m.user_id AND m.user_id IN (SELECT id FROM users)""", _TM + ("teams", "users"))
def _t7(fx):
    m, tur, r = _t(fx)
    req = fx.teams.select(F.col("id").alias("team_id"), F.col("created_by").alias("caller_id"))
    return T.team_members(req, m, fx.users, tur, r)


@register("unassigned_roles", """
SELECT m.id AS team_membership_id, r.id, r.role_name FROM team_memberships m JOIN team_roles r USING (team_id)
EXCEPT
SELECT a.team_membership_id, r.id, r.role_name FROM team_user_roles a JOIN team_roles r ON r.id = a.role_id""", _TM)
def _t8(fx):
    m, tur, r = _t(fx)
    return T.unassigned_roles(m.select(F.col("id").alias("team_membership_id")), m, tur, r)


@register("unassigned_role_classes", """
SELECT m.id AS team_membership_id, count(*) FILTER (WHERE a.role_id IS NOT NULL) AS n_held,
 ifnull(string_agg(CAST(a.role_id AS VARCHAR), ',' ORDER BY a.role_id), '') AS held
FROM team_memberships m LEFT JOIN (SELECT DISTINCT team_membership_id, role_id FROM team_user_roles) a ON a.team_membership_id = m.id
GROUP BY m.id""", _TM)
def _t8c(fx):
    members, held, _ = T.unassigned_role_classes(fx.team_memberships.select(F.col("id").alias("team_membership_id")), fx.team_user_roles, fx.team_roles)
    per = held.groupBy("class_id").agg(F.count("id").alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    return members.join(per, "class_id", "left").select(
        "team_membership_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_held"), F.coalesce("ids", F.lit("")).alias("held"))


# team creation requests: customers of the BUILDING segment each found a team
_BOOT_REQ = """SELECT c_custkey AS request_id, concat('team ', c_name) AS name, c_mktsegment AS team_industry,
 5 + CAST(c_custkey % 4 AS INTEGER) AS team_size, c_acctbal < 0 AS is_private, c_custkey AS created_by
FROM customer WHERE c_mktsegment = 'BUILDING'"""


_BOOT_IDS = f"""breq AS ({_BOOT_REQ}), bteam AS (SELECT *, {new_id_sql('team', 'request_id')} AS tid FROM breq),
i AS (SELECT *, {new_id_sql('team_role', 'tid', "'owner'")} AS rid, {new_id_sql('membership', 'tid', 'created_by')} AS mid FROM bteam)"""


def _boot_requests(fx):
    return fx.customer.where(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias("request_id"), F.concat(F.lit("team "), "c_name").alias("name"),
        F.col("c_mktsegment").alias("team_industry"), (5 + (F.col("c_custkey") % 4).cast("int")).alias("team_size"),
        (F.col("c_acctbal") < 0).alias("is_private"), F.col("c_custkey").alias("created_by"))


@register("bootstrap_teams", f"""
WITH {_BOOT_IDS}
SELECT 'team' AS kind, tid AS id, tid AS team_id, CAST(created_by AS VARCHAR) AS ref_id, name AS label FROM i
UNION ALL SELECT 'role', rid, tid, NULL, 'owner' FROM i
UNION ALL SELECT 'membership', mid, tid, CAST(created_by AS VARCHAR), NULL FROM i
UNION ALL SELECT 'assignment', {new_id_sql('assignment', 'mid', 'rid')}, NULL, rid, mid FROM i""", ())
def _t9(fx):
    out = T.bootstrap_teams(_boot_requests(fx))
    n = F.lit(None)
    return (out["teams"].select(F.lit("team").alias("kind"), "id", F.col("id").alias("team_id"),
                                F.col("created_by").cast("string").alias("ref_id"), F.col("name").alias("label"))
            .unionByName(out["team_roles"].select(F.lit("role").alias("kind"), "id", "team_id",
                                                  n.cast("string").alias("ref_id"), F.col("role_name").alias("label")))
            .unionByName(out["team_memberships"].select(F.lit("membership").alias("kind"), "id", "team_id",
                                                        F.col("user_id").cast("string").alias("ref_id"), n.cast("string").alias("label")))
            .unionByName(out["team_user_roles"].select(
                F.lit("assignment").alias("kind"), "id", n.cast("string").alias("team_id"), F.col("role_id").alias("ref_id"),
                F.col("team_membership_id").alias("label"))))


def _assign_requests(fx):
    # every membership asks for all non-owner roles of its team
    roles = (fx.team_roles.where(F.col("role_name") != "owner").groupBy("team_id")
             .agg(F.collect_list("id").alias("selected_roles")))
    return fx.team_memberships.select(F.col("id").alias("team_membership_id"), "team_id").join(roles, "team_id")


_ASSIGN = """req AS (SELECT DISTINCT tm.id AS team_membership_id, tr.id AS role_id FROM team_memberships tm
  JOIN team_roles tr ON tr.team_id = tm.team_id AND tr.role_name <> 'owner')"""


@register("assign_roles", f"""
WITH {_ASSIGN}
SELECT {new_id_sql('assignment', 'team_membership_id', 'role_id')} AS id, team_membership_id, role_id FROM req r
WHERE NOT EXISTS (SELECT 1 FROM team_user_roles t WHERE t.team_membership_id = r.team_membership_id AND t.role_id = r.role_id)""",
          _TM)
def _t10(fx):
    return T.assign_roles(_assign_requests(fx), fx.team_user_roles)[0]


@register("assign_roles_conflicts", f"""
WITH {_ASSIGN}
SELECT team_membership_id, role_id FROM req r
WHERE EXISTS (SELECT 1 FROM team_user_roles t WHERE t.team_membership_id = r.team_membership_id AND t.role_id = r.role_id)""",
          _TM)
def _t10c(fx):
    return T.assign_roles(_assign_requests(fx), fx.team_user_roles)[1]


# role requests: each order asks its team (orderkey % 25) for a role
_ROLE_REQ = """SELECT o_orderkey AS request_id, o_orderkey % 25 AS team_id,
 CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE concat('lead-', o_orderstatus) END AS role_name FROM orders"""


def _role_requests(fx):
    o = fx.orders
    return o.select(F.col("o_orderkey").alias("request_id"), (F.col("o_orderkey") % 25).alias("team_id"),
                    F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
                    .otherwise(F.concat(F.lit("lead-"), "o_orderstatus")).alias("role_name"))


@register("add_roles", f"""
WITH req AS ({_ROLE_REQ}), first AS (SELECT team_id, role_name, MIN(request_id) AS request_id FROM req GROUP BY 1, 2)
SELECT {new_id_sql('team_role', 'team_id', 'role_name')} AS id, role_name, team_id FROM first f
WHERE NOT EXISTS (SELECT 1 FROM team_roles r WHERE r.team_id = f.team_id AND r.role_name = f.role_name)""",
          ("team_roles",))
def _t11(fx):
    return T.add_roles(_role_requests(fx), fx.team_roles)[0]


@register("add_roles_conflicts", f"""
WITH req AS ({_ROLE_REQ}), first AS (SELECT team_id, role_name, MIN(request_id) AS request_id FROM req GROUP BY 1, 2)
SELECT q.request_id, q.team_id, q.role_name, 'duplicate in batch' AS reason FROM req q JOIN first f
 ON f.team_id = q.team_id AND f.role_name = q.role_name WHERE q.request_id <> f.request_id
UNION ALL
SELECT f.request_id, f.team_id, f.role_name, 'role exists' FROM first f
WHERE EXISTS (SELECT 1 FROM team_roles r WHERE r.team_id = f.team_id AND r.role_name = f.role_name)""",
          ("team_roles",))
def _t11c(fx):
    return T.add_roles(_role_requests(fx), fx.team_roles)[1]


@register("add_team_activities", f"""
SELECT {new_id_sql('team_activity', 'p_partkey')} AS id, p_partkey % 25 AS team_id, concat('new ', p_brand) AS activity_name,
 CAST(p_size % 11 - 5 AS INTEGER) AS points, DATE '2024-02-01' AS created_at, DATE '2024-02-01' AS updated_at,
 p_container_roles AS roles
FROM (SELECT *, CASE WHEN p_size > 25 THEN '1-URGENT' ELSE '' END AS p_container_roles FROM part)""", ())
def _t11a(fx):
    return T.add_team_activities(_activity_requests(fx)).select(
        "id", "team_id", "activity_name", "points", "created_at", "updated_at", F.array_join("activity_roles", ",").alias("roles"))


def _activity_requests(fx):
    return fx.part.select(
        F.col("p_partkey").alias("request_id"), (F.col("p_partkey") % 25).alias("team_id"), F.concat(F.lit("new "), "p_brand").alias("activity_name"),
        (F.col("p_size") % 11 - 5).cast("int").alias("points"), F.expr("DATE '2024-02-01'").alias("created_at"),
        F.when(F.col("p_size") > 25, F.array(F.lit("1-URGENT"))).otherwise(F.array().cast("array<string>")).alias("activity_roles"))


# ---- invitations ----

@register("inbox", """
SELECT ti.recipient_id, ti.id AS invitation_id, ti.team_id, t.name AS team_name, t.team_industry, t.team_size,
 CAST(row_number() OVER (PARTITION BY ti.recipient_id ORDER BY ti.created_at DESC, ti.id DESC) AS INTEGER) AS pos
FROM team_invitations ti JOIN teams t ON ti.team_id = t.id""", ("team_invitations", "teams"))
def _v1(fx):
    return V.inbox(fx.team_invitations, fx.teams)


@register("unread_counts", """
SELECT u.id AS recipient_id, (SELECT COUNT(recipient_id) FROM team_invitations ti
  WHERE ti.recipient_id = u.id AND ti.seen = false) AS invite_count FROM users u""", ("users", "team_invitations"))
def _v2(fx):
    return V.unread_counts(fx.team_invitations, fx.users)


@register("mark_seen", """
SELECT id, team_id, sender_id, recipient_id, status, created_at,
 seen OR recipient_id IN (SELECT user_id FROM invite_responses) AS seen
FROM team_invitations""", ("team_invitations", "invite_responses"))
def _v3(fx):
    return V.mark_seen(fx.team_invitations, fx.invite_responses)


@register("apply_responses_invitations", """
SELECT * FROM team_invitations WHERE id NOT IN (SELECT invitation_id FROM invite_responses)""",
          ("team_invitations", "invite_responses"))
def _v4i(fx):
    return V.apply_responses(fx.team_invitations, fx.team_memberships, fx.invite_responses)[0]


@register("apply_responses_memberships", f"""
SELECT CAST(id AS VARCHAR) AS id, team_id, user_id FROM team_memberships
UNION ALL
SELECT {new_id_sql('membership', 'team_id', 'user_id')}, team_id, user_id FROM (SELECT DISTINCT team_id, user_id FROM invite_responses
 WHERE response = 'accept') a
WHERE NOT EXISTS (SELECT 1 FROM team_memberships m WHERE m.team_id = a.team_id AND m.user_id = a.user_id)""",
          ("team_memberships", "team_invitations", "invite_responses"))
def _v4m(fx):
    return V.apply_responses(fx.team_invitations, fx.team_memberships, fx.invite_responses)[1]


@register("create_invitations", f"""
SELECT 1000000000 + p.user_id AS id, p.team_id, t.created_by AS sender_id, p.user_id AS recipient_id,
 'pending' AS status, TIMESTAMP '{AS_OF} 12:00:00' AS created_at, false AS seen
FROM pairs p JOIN teams t ON t.id = p.team_id""", ("pairs", "teams"))
def _v5(fx):
    req = fx.pairs.join(fx.teams.select(F.col("id").alias("team_id"), "created_by"), "team_id").select(
        (F.lit(1_000_000_000) + F.col("user_id")).alias("id"), "team_id", F.col("created_by").alias("sender_id"),
        F.col("user_id").alias("recipient_id"), F.expr(f"TIMESTAMP_NTZ '{AS_OF} 12:00:00'").alias("created_at"))
    return V.create_invitations(req)


# ---- users ----

@register("search_users", """
WITH hits AS (
 SELECT s.search_id, u.id, u.username, ti.id AS inv
 FROM searches s JOIN users u ON u.username ILIKE concat('%', s.q, '%') AND u.id <> s.caller_id
 LEFT JOIN team_invitations ti ON u.id = ti.recipient_id AND ti.team_id = s.team_id)
SELECT search_id, CAST(rn AS INTEGER) AS rn, id, username, has_been_invited FROM (
 SELECT search_id, id, username, inv IS NOT NULL AS has_been_invited,
  row_number() OVER (PARTITION BY search_id ORDER BY username, id, inv NULLS FIRST) AS rn FROM hits) WHERE rn <= 10""",
          ("searches", "users", "team_invitations"))
def _u1(fx):
    return U.search_users(fx.searches, fx.users, fx.team_invitations)


_KEYS = """keys AS (
 SELECT 'email' AS kind, email AS key FROM registrations
 UNION ALL SELECT 'username', username FROM registrations
 UNION ALL SELECT 'google_id', concat('g-', CAST(id AS VARCHAR)) FROM registrations)"""


def _keys(fx):
    r = fx.registrations
    return (r.select(F.lit("email").alias("kind"), F.col("email").alias("key"))
            .unionByName(r.select(F.lit("username").alias("kind"), F.col("username").alias("key")))
            .unionByName(r.select(F.lit("google_id").alias("kind"),
                                  F.concat(F.lit("g-"), F.col("id").cast("string")).alias("key"))))


@register("resolve_users", f"""
WITH {_KEYS}
SELECT k.kind, k.key, u.id, u.username, u.email, u.google_id FROM keys k JOIN users u
 ON (k.kind = 'email' AND u.email = k.key) OR (k.kind = 'username' AND u.username = k.key)
 OR (k.kind = 'google_id' AND u.google_id = k.key)""", ("registrations", "users"))
def _u2(fx):
    return U.resolve_users(_keys(fx), fx.users)


_U4_SQL = """
WITH r AS (SELECT pr.token, pr.expires_at, u.email FROM password_reset pr JOIN users u ON u.id = pr.user_id),
a AS (SELECT a.attempt_id, a.token, a.attempted_at, r.expires_at, r.email FROM reset_attempts a LEFT JOIN r ON r.token = a.token),
f AS (SELECT token, MIN(attempted_at) AS fa FROM a WHERE expires_at IS NOT NULL AND attempted_at <= expires_at GROUP BY token),
ff AS (SELECT f.token, f.fa, MIN(a.attempt_id) AS fid FROM f JOIN a ON a.token = f.token AND a.attempted_at = f.fa
       AND a.attempted_at <= a.expires_at GROUP BY f.token, f.fa)
SELECT a.attempt_id, a.token, o.outcome, CASE WHEN o.outcome = 'valid' THEN a.email END AS email
FROM a LEFT JOIN ff ON ff.token = a.token,
LATERAL (SELECT CASE WHEN a.expires_at IS NULL THEN 'invalid'
  WHEN ff.token IS NOT NULL AND (a.attempted_at > ff.fa OR (a.attempted_at = ff.fa AND a.attempt_id > ff.fid)) THEN 'invalid'
  WHEN a.attempted_at > a.expires_at THEN 'expired' ELSE 'valid' END AS outcome) o"""
_U4_VIEWS = ("password_reset", "users", "reset_attempts")


@register("redeem_resets", _U4_SQL, _U4_VIEWS)
def _u4(fx):
    return U.redeem_resets(fx.password_reset, fx.reset_attempts, fx.users)


@register("account_kind", """
SELECT id, username, email, password_hash IS NOT NULL AS has_password,
 CASE WHEN password_hash IS NULL THEN google_id END AS google_id FROM users""", ("users",))
def _u5(fx):
    return U.account_kind(fx.users)


# ---- feedback ----

@register("vote_tally", """
SELECT s.id, s.title, CAST(s.upvote + COALESCE((SELECT SUM(delta) FROM suggestion_votes v WHERE v.suggestion_id = s.id), 0)
 AS INTEGER) AS upvote FROM suggestions s""", ("suggestions", "suggestion_votes"))
def _b1(fx):
    return B.vote_tally(fx.suggestions, fx.suggestion_votes)


_TALLY = """tally AS (SELECT s.id, s.title, s.description, s.user_id, CAST(s.upvote + COALESCE(v.d, 0) AS INTEGER) AS upvote
 FROM suggestions s LEFT JOIN (SELECT suggestion_id, SUM(delta) AS d FROM suggestion_votes GROUP BY 1) v
 ON v.suggestion_id = s.id)"""


@register("suggestion_ranking", f"WITH {_TALLY} SELECT id, title, description, user_id, upvote FROM tally",
          ("suggestions", "suggestion_votes"))
def _b2(fx):
    return B.suggestion_ranking(B.vote_tally(fx.suggestions, fx.suggestion_votes), fx.suggestions)


@register("suggestion_top10", f"""
WITH {_TALLY} SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY upvote DESC, id) AS INTEGER) AS pos,
 id, title, description, user_id, upvote FROM tally) WHERE pos <= 10""", ("suggestions", "suggestion_votes"))
def _b2t(fx):
    return B.suggestion_ranking(B.vote_tally(fx.suggestions, fx.suggestion_votes), fx.suggestions, limit=10)


@register("add_suggestions", """
SELECT s.id, s.title, s.description, u.username, 0 AS upvote FROM suggestions s JOIN users u ON u.id = s.user_id""",
          ("suggestions", "users"))
def _b3(fx):
    return B.add_suggestions(fx.suggestions.select("id", "title", "description", "user_id"), fx.users)


@register("admit_registrations", """
WITH RECURSIVE o AS (
 SELECT row_number() OVER (ORDER BY r.id) AS rn, r.id, r.email, r.username,
  CASE WHEN r.email IN (SELECT email FROM users) THEN 'Email already exists'
       WHEN r.username IN (SELECT username FROM users) THEN 'Username already exists' END AS pre
 FROM registrations r),
s AS (
 SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS outcome,
  CAST([] AS VARCHAR[]) AS emails, CAST([] AS VARCHAR[]) AS names
 UNION ALL
 SELECT o.rn, o.id, x.outcome,
  CASE WHEN x.outcome = 'accepted' THEN list_append(s.emails, o.email) ELSE s.emails END,
  CASE WHEN x.outcome = 'accepted' THEN list_append(s.names, o.username) ELSE s.names END
 FROM s JOIN o ON o.rn = s.rn + 1,
 LATERAL (SELECT CASE WHEN o.pre IS NOT NULL THEN o.pre
   WHEN list_contains(s.emails, o.email) THEN 'Email already exists'
   WHEN list_contains(s.names, o.username) THEN 'Username already exists' ELSE 'accepted' END AS outcome) x)
SELECT id, outcome FROM s WHERE rn > 0""", ("registrations", "users"))
def _u3(fx):
    return U.admit_registrations(fx.users, fx.registrations)
