"""Registered streaming operators.

Each one replays its input table as a file stream in event order (under
the shared checkpoint location), drives the streaming query to the end of
the input with an AvailableNow trigger (processors that wait for the watermark
get a closing heartbeat row), and returns the sink's table. The
oracle is the batch twin's SQL: the streamed result must equal it.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..streaming import runner
from ..streaming import stateful as L
from ..streaming import streams as S
from ..streaming.ordered import with_heartbeat
from .q_goals import _G2_SQL, _G4_SQL
from .q_teams import _U4_SQL, _U4_VIEWS
from .registry import AS_OF, register


def _run(fx, name, tables, build, mode="append", heartbeat=False):
    """Stage each (df, ts_col) in event order (stored once before, with a closing heartbeat if asked for), build the
    stream, run it."""
    spark = fx.spark
    base = runner.scratch(spark, name)
    streams = []
    for i, (df, ts) in enumerate(tables):
        path = os.path.join(base, f"in{i}")
        df = runner.stored(df, os.path.join(base, f"table{i}"))
        runner.stage_in_event_order(with_heartbeat(df, ts) if heartbeat else df, ts, path)
        streams.append(runner.file_stream(spark, path, df.schema, runner.files_per_batch(spark, path)))
    out = os.path.join(base, "out")
    info = runner.run_available_now(build(*streams), mode, out, os.path.join(base, "ckpt"))
    return spark.read.parquet(out), info


_L1 = """SELECT user_id, CAST(logged_at AS DATE) AS date, CAST(SUM(points) AS BIGINT) AS total_points,
 CAST(SUM(duration) AS BIGINT) AS total_minutes,
 CAST(SUM(CASE WHEN points > 0 THEN duration ELSE 0 END) AS BIGINT) AS productive_time,
 CAST(SUM(CASE WHEN points < 0 THEN duration ELSE 0 END) AS BIGINT) AS unproductive_time, COUNT(*) AS n_logs
FROM user_activity_logs GROUP BY user_id, CAST(logged_at AS DATE)"""


@register("daily_rollup_stream", _L1, ("user_activity_logs",))
def _l1(fx):
    out, _ = _run(fx, "l1", [(fx.user_activity_logs, "logged_at")], S.daily_rollup_stream, "update")
    return runner.latest_per_key(out, ["user_id", "date"])


@register("vote_stream", """
SELECT s.id, s.title, CAST(s.upvote + COALESCE(v.d, 0) AS INTEGER) AS upvote FROM suggestions s
LEFT JOIN (SELECT suggestion_id, SUM(delta) AS d FROM suggestion_votes GROUP BY 1) v ON v.suggestion_id = s.id""",
          ("suggestions", "suggestion_votes"))
def _l7(fx):
    out, _ = _run(fx, "l7", [(fx.suggestion_votes, "ts")], S.vote_stream, "update")
    cur = runner.latest_per_key(out, ["suggestion_id"])
    s = fx.suggestions
    return (s.join(cur.withColumnRenamed("suggestion_id", "id"), "id", "left")
            .select("id", "title", (F.col("upvote") + F.coalesce("votes", F.lit(0))).cast("int").alias("upvote")))


_CONNECTED = f"CAST(logged_at AS DATE) = DATE '{AS_OF}'"  # users online on AS_OF


@register("invite_notify_stream", f"""
SELECT ti.id AS invitation_id, ti.recipient_id, ti.team_id, 'Invite received' AS message FROM team_invitations ti
WHERE ti.recipient_id IN (SELECT user_id FROM user_activity_logs WHERE {_CONNECTED})""",
          ("team_invitations", "user_activity_logs"))
def _l5(fx):
    connected = runner.stored(fx.user_activity_logs.where(F.expr(_CONNECTED)).select("user_id").distinct(),
                              runner.scratch(fx.spark, "l5-connected"))  # not derived anew in every micro-batch
    out, _ = _run(fx, "l5", [(fx.team_invitations, "created_at")],
                  lambda inv: S.invite_notify_stream(inv, connected))
    return out.drop("batch_id")


@register("reset_redeem_stream", _U4_SQL, _U4_VIEWS)
def _l6(fx):
    events = L.reset_events(fx.reset_attempts, fx.password_reset, fx.users)
    out, _ = _run(fx, "l6", [(events, "at")], L.reset_redeem_stream, heartbeat=True)
    return out.drop("batch_id")


@register("streak_stream", """
WITH d AS (SELECT DISTINCT user_id, CAST(logged_at AS DATE) AS day FROM user_activity_logs),
i AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM d),
c AS (SELECT user_id, day, CAST(row_number() OVER (PARTITION BY user_id, island ORDER BY day) AS INTEGER) AS streak_count
      FROM i)
SELECT user_id, day AS date, streak_count,
 streak_count > COALESCE(MAX(streak_count) OVER (PARTITION BY user_id ORDER BY day
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS is_streak_record FROM c""", ("user_activity_logs",))
def _l3(fx):
    out, _ = _run(fx, "l3", [(fx.user_activity_logs, "logged_at")], L.streak_stream)
    return out.drop("batch_id")


def _goal_run(fx):
    ev = L.goal_events(fx.user_activity_logs, fx.user_goals)
    return _run(fx, "l2", [(ev, "at")], L.goal_stream, heartbeat=True)[0]


@register("goal_stream", _G2_SQL, ("user_activity_logs", "user_goals"))
def _l2(fx):
    return (_goal_run(fx).where(F.col("kind") == "transition")
            .select("user_id", "date", "id", F.col("at").alias("logged_at"), "transition"))


@register("reminder_stream", _G4_SQL, ("user_activity_logs", "user_goals"))
def _l4(fx):
    return (_goal_run(fx).where(F.col("kind") == "reminder")
            .select("user_id", F.col("at").alias("tick_at"), "total_points", "goal_points"))
