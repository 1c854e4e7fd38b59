"""Registered id audit: new rows of every producer beside the stored rows of their table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import new_id_sql
from ..operators import ingest as I
from ..operators import invitations as V
from ..operators import teams as T
from . import q_ingest, q_teams
from .registry import register

#: ids made by ``functions.ids.new_id``
HEX_ID = r"\A[0-9a-f]{32}\z"


def repeated_ids(tables: dict[str, list[DataFrame]]) -> DataFrame:
    """table, number of rows (stored and new) and of ids that several rows share (0 where ids are unique). One row per
    id is shuffled; the tables are counted together. Ids of 32 hex digits are most of what is shuffled and do not
    compress: they travel as the 16 bytes they spell, under a number of their own (other ids: their text, an even
    number), so two ids are equal there if and only if they are equal as texts."""
    names, text = list(tables), F.col("id").cast("string")
    hexed = F.coalesce(text.rlike(HEX_ID), F.lit(False))
    rows = reduce(DataFrame.unionByName, [
        df.select((F.lit(2 * k) + hexed.cast("int")).alias("kind"), F.when(hexed, F.unhex(text)).otherwise(F.encode(text, "UTF-8")).alias("id"))
        for k, dfs in enumerate(tables.values()) for df in dfs])
    per = rows.groupBy("kind", "id").agg(F.count(F.lit(1)).alias("c"))
    name = reduce(lambda c, k: F.when(F.col("kind").isin(2 * k, 2 * k + 1), F.lit(names[k])).otherwise(c), range(len(names) - 1), F.lit(names[-1]))
    return (per.select(name.alias("table_name"), "c").groupBy("table_name")
            .agg(F.sum("c").alias("n_rows"), F.count(F.when(F.col("c") > 1, 1)).alias("repeated_ids")))


_SQL = f"""{q_ingest._I7},
{q_ingest._REQ}, k AS (SELECT *, {q_ingest._KIND} AS kind FROM good),
{q_teams._BOOT_IDS},
{q_teams._ASSIGN.replace("req AS", "areq AS", 1)},
rreq AS (SELECT DISTINCT team_id, role_name FROM ({q_teams._ROLE_REQ})),
acc AS (SELECT DISTINCT team_id, user_id FROM invite_responses WHERE response = 'accept'),
ids AS (
SELECT 'user_activities' AS table_name, CAST(id AS VARCHAR) AS id FROM user_activities
UNION ALL SELECT 'user_activities', {new_id_sql('activity', 'id')} FROM k WHERE kind = 'new'
UNION ALL SELECT 'user_activities', {new_id_sql('default_activity', 'u.id', 'r.k')} FROM users u, activity_rates r WHERE u.google_id IS NULL
UNION ALL SELECT 'user_activity_logs', CAST(id AS VARCHAR) FROM user_activity_logs
UNION ALL SELECT 'user_activity_logs', {new_id_sql('log', 'id')} FROM k
UNION ALL SELECT 'user_activity_logs', id FROM cand
UNION ALL SELECT 'teams', CAST(id AS VARCHAR) FROM teams UNION ALL SELECT 'teams', tid FROM i
UNION ALL SELECT 'team_roles', CAST(id AS VARCHAR) FROM team_roles UNION ALL SELECT 'team_roles', rid FROM i
UNION ALL SELECT 'team_roles', {new_id_sql('team_role', 'team_id', 'role_name')} FROM rreq
  WHERE (team_id, role_name) NOT IN (SELECT (team_id, role_name) FROM team_roles)
UNION ALL SELECT 'team_memberships', CAST(id AS VARCHAR) FROM team_memberships UNION ALL SELECT 'team_memberships', mid FROM i
UNION ALL SELECT 'team_memberships', {new_id_sql('membership', 'team_id', 'user_id')} FROM acc
  WHERE (team_id, user_id) NOT IN (SELECT (team_id, user_id) FROM team_memberships)
UNION ALL SELECT 'team_user_roles', CAST(id AS VARCHAR) FROM team_user_roles
UNION ALL SELECT 'team_user_roles', {new_id_sql('assignment', 'mid', 'rid')} FROM i
UNION ALL SELECT 'team_user_roles', {new_id_sql('assignment', 'team_membership_id', 'role_id')} FROM areq
  WHERE (team_membership_id, role_id) NOT IN (SELECT (team_membership_id, role_id) FROM team_user_roles)
UNION ALL SELECT 'team_activities', CAST(id AS VARCHAR) FROM team_activities
UNION ALL SELECT 'team_activities', {new_id_sql('team_activity', 'p_partkey')} FROM part),
per AS (SELECT table_name, id, count(*) AS c FROM ids GROUP BY ALL)
SELECT table_name, CAST(sum(c) AS BIGINT) AS n_rows, count(*) FILTER (WHERE c > 1) AS repeated_ids FROM per GROUP BY table_name"""


@register("repeated_ids", _SQL, q_ingest._I7_VIEWS + ("requests_json", "users", "activity_rates", "teams", "team_roles", "team_memberships",
                                                     "team_user_roles", "team_activities", "invite_responses"))
def _ids(fx):
    new_acts, logs = I.ingest_structured_logs(q_ingest._requests(fx)[0])
    texts = q_ingest._text_logs(fx)
    boot = T.bootstrap_teams(q_teams._boot_requests(fx))
    return repeated_ids({
        "user_activities": [fx.user_activities, new_acts, I.seed_default_catalog(fx.users.withColumn("set_default", F.col("google_id").isNull()))],
        "user_activity_logs": [fx.user_activity_logs, logs, texts["decided"]],
        "teams": [fx.teams, boot["teams"]],
        "team_roles": [fx.team_roles, boot["team_roles"], T.add_roles(q_teams._role_requests(fx), fx.team_roles)[0]],
        "team_memberships": [boot["team_memberships"], V.apply_responses(fx.team_invitations, fx.team_memberships, fx.invite_responses)[1]],
        "team_user_roles": [fx.team_user_roles, boot["team_user_roles"], T.assign_roles(q_teams._assign_requests(fx), fx.team_user_roles)[0]],
        "team_activities": [fx.team_activities, T.add_team_activities(q_teams._activity_requests(fx))],
    })
