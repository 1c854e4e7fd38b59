"""Stream = batch, restart without duplicates, late rows counted."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from helpers import GOALS, LOGS, USERS

from habitlake.operators import goals as G
from habitlake.operators import users as U
from habitlake.sources.fixtures import Fixtures
from habitlake.streaming import runner
from habitlake.streaming import stateful as L
from habitlake.streaming import streams as S
from habitlake.streaming.ordered import GROUPS, with_heartbeat
from conftest import SF_SMALL


def _rollup_batch(logs):
    p, d = F.col("points"), F.col("duration")
    return logs.groupBy("user_id", F.to_date("logged_at").alias("date")).agg(
        F.sum(p).alias("total_points"), F.count(F.lit(1)).alias("n_logs"))


def test_restart_no_duplicates_and_late_rows(spark):
    fx = Fixtures(spark, SF_SMALL)
    logs = fx.user_activity_logs
    base = runner.scratch(spark, "t-restart")
    src, out, ck = (os.path.join(base, x) for x in ("in", "out", "ckpt"))
    cut = "2024-01-20"
    early = logs.where(F.col("logged_at") < F.lit(cut).cast("timestamp_ntz"))
    late_part = logs.where(F.col("logged_at") >= F.lit(cut).cast("timestamp_ntz"))
    runner.stage_in_event_order(early, "logged_at", src)
    build = lambda: S.daily_rollup_stream(runner.file_stream(spark, src, logs.schema), late="1 hour")
    runner.run_available_now(build(), "update", out, ck)
    n1 = spark.read.parquet(out).select("batch_id").distinct().count()
    # no new input: a restart adds no batch
    runner.run_available_now(build(), "update", out, ck)
    assert spark.read.parquet(out).select("batch_id").distinct().count() == n1
    # the rest arrives, then a file of rows far behind the watermark
    runner.stage_in_event_order(late_part, "logged_at", src)
    runner.run_available_now(build(), "update", out, ck)
    stale = early.limit(5)
    stale.write.mode("append").parquet(src)
    info = runner.run_available_now(build(), "update", out, ck)
    # counted after the map-side partial aggregate (rows merged per key), so
    # at least one; the totals below prove all five re-sent rows were ignored
    assert info["dropped"] >= 1
    got = runner.latest_per_key(spark.read.parquet(out), ["user_id", "date"])
    want = _rollup_batch(logs)
    a = sorted((r.user_id, r.date, r.total_points, r.n_logs) for r in got.collect())
    b = sorted((r.user_id, r.date, r.total_points, r.n_logs) for r in want.collect())
    assert a == b


def _files_in_order(spark, rows_per_file, schema, src):
    """One file per list of rows, read in this order."""
    jvm = spark.sparkContext._jvm
    for i, rows_ in enumerate(rows_per_file):
        spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(f"{src}-{i}")
        fs = jvm.org.apache.hadoop.fs.Path(src).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(src))
        for f in runner._files(fs, jvm.org.apache.hadoop.fs.Path(f"{src}-{i}")):
            to = jvm.org.apache.hadoop.fs.Path(src, f"part{i:03d}.parquet")
            fs.rename(f.getPath(), to)
            fs.setTimes(to, 1_000_000_000_000 + 1000 * i, -1)


def _goal_rows(out):
    t = sorted((r.user_id, r.date, r.id, r.transition) for r in out.collect() if r.kind == "transition")
    m = sorted((r.user_id, r["at"], r.total_points, r.goal_points) for r in out.collect() if r.kind == "reminder")
    return t, m


def _batch_rows(logs, goals):
    flips = G.goal_transitions(logs, goals, "reference")
    return (sorted((r.user_id, r.date, r.id, r.transition) for r in flips.collect()),
            sorted((r.user_id, r.tick_at, r.total_points, r.goal_points) for r in G.goal_reminders(goals, flips, logs).collect()))


def _goal_tables(spark, rng):
    logs, goals = [], []
    for user in (1, 2, 3):
        for day in (1, 2, 3):
            t0 = dt.datetime(2024, 1, day)
            goals.append((user * 10 + day, user, t0.date(), rng.choice([0, 3, 12]), t0 + dt.timedelta(hours=1), "x"))
            for k in range(rng.randrange(12)):
                logs.append((user * 1000 + day * 100 + k, user, None, 5, rng.choice([-6, -2, 4, 9]), "x", t0 + dt.timedelta(minutes=rng.randrange(1440))))
    return spark.createDataFrame(logs, LOGS), spark.createDataFrame(goals, GOALS)


def _run_goals(spark, files, schema, late):
    base = runner.scratch(spark, "t-goals")
    _files_in_order(spark, files, schema, os.path.join(base, "in"))
    stream = L.goal_stream(runner.file_stream(spark, os.path.join(base, "in"), schema), late=late)
    runner.run_available_now(stream, "append", os.path.join(base, "out"), os.path.join(base, "ck"))
    return spark.read.parquet(os.path.join(base, "out"))


def test_goal_stream_of_shuffled_files_equals_batch(spark):
    """Files out of order by up to a day: flips and reminders are those of G2 and G4, to the last tick."""
    rng = random.Random(3)
    logs, goals = _goal_tables(spark, rng)
    events = with_heartbeat(L.goal_events(logs, goals), "at")
    rows_ = [tuple(r) for r in events.collect()]
    beat = [r for r in rows_ if r[2] == -1]
    rest = sorted((r for r in rows_ if r[2] != -1), key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(1400)))
    cut = len(rest) // 4
    files = [rest[:cut], rest[cut:2 * cut], rest[2 * cut:], beat]
    assert _goal_rows(_run_goals(spark, files, events.schema, "1 day")) == _batch_rows(logs, goals)


def test_late_row_of_an_earlier_day_changes_nothing_else(spark):
    """A row behind the watermark is ignored; every other day (and user) gives what it gives without it."""
    logs, goals = _goal_tables(spark, random.Random(8))
    events = with_heartbeat(L.goal_events(logs, goals), "at")
    rows_ = sorted((tuple(r) for r in events.collect()), key=lambda r: r[1])
    stale = (1, dt.datetime(2024, 1, 1, 12), 1, 999_999, 500)
    days = [[r for r in rows_ if r[1].day == d and r[2] != -1] for d in (1, 2, 3)]
    files = [*days[:2], [stale, *days[2]], [r for r in rows_ if r[2] == -1]]
    assert _goal_rows(_run_goals(spark, files, events.schema, "1 hour")) == _batch_rows(logs, goals)


def test_token_stream_admits_one_timely_attempt(spark):
    """Attempts out of order over files: valid once, then invalid; expired; unknown; the same as the batch operator."""
    t0 = dt.datetime(2024, 1, 1, 10)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    resets = spark.createDataFrame([(100, 1, t0, at(20)), (101, 2, t0, at(20)), (102, 9, t0, at(20))],
                                   "token long, user_id long, created_at timestamp_ntz, expires_at timestamp_ntz")
    users = spark.createDataFrame([(1, "a", "a@x", None), (2, "b", "b@x", None)], USERS)
    attempts = spark.createDataFrame([(1, 100, at(15)), (2, 100, at(5)), (3, 100, at(30)), (4, 101, at(25)), (5, 101, at(26)), (6, 77, at(1)),
                                      (7, 102, at(3)), (8, 101, at(20)), (9, 101, at(20)), (10, None, at(2))], "attempt_id long, token long, attempted_at timestamp_ntz")
    events = with_heartbeat(L.reset_events(attempts, resets, users), "at")
    rows_ = [tuple(r) for r in events.collect()]
    base = runner.scratch(spark, "t-tokens")
    files = [[r for r in rows_ if r[2] == 1 and r[3] % 2], [r for r in rows_ if r[2] == 0 or r[2] == 1 and r[3] % 2 == 0], [r for r in rows_ if r[2] == -1]]
    _files_in_order(spark, files, events.schema, os.path.join(base, "in"))
    stream = L.reset_redeem_stream(runner.file_stream(spark, os.path.join(base, "in"), events.schema))
    runner.run_available_now(stream, "append", os.path.join(base, "out"), os.path.join(base, "ck"))
    key = lambda r: (r.attempt_id, r.outcome, r.email)
    got = sorted(map(key, spark.read.parquet(os.path.join(base, "out")).collect()))
    assert got == sorted(map(key, U.redeem_resets(resets, attempts, users).collect()))
    assert [x[:2] for x in got if x[1] == "valid"] == [(2, "valid"), (8, "valid")]


def test_staging_keeps_event_order_and_bounds_files(spark):
    """A bulk import at one instant is parted; files are in event order."""
    t0 = dt.datetime(2024, 1, 1)
    df_ = spark.range(4000).select(F.col("id"), F.lit(t0).cast("timestamp_ntz").alias("at")).union(
        spark.range(4000, 5000).select("id", (F.lit(t0).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id"))).alias("at")))
    path = runner.stage_in_event_order(df_, "at", runner.scratch(spark, "t-stage"), rows_per_file=500)
    out = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")).orderBy("f").collect()
    assert sum(r.n for r in out) == 5000 and max(r.n for r in out) < 1500
    assert all(a.hi <= b.lo for a, b in zip(out, out[1:]))


def test_streak_stream_ignores_late_earlier_day(spark):
    """A day that arrives after a later day does not rewrite the streak."""
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("logged_at", T.TimestampNTZType())])
    base = runner.scratch(spark, "t-late-day")
    src = os.path.join(base, "in")
    for day in ["2024-01-01", "2024-01-03", "2024-01-02", "2024-01-04"]:  # 01-02 arrives late
        spark.createDataFrame([(1, dt.datetime.fromisoformat(day + " 10:00:00"))], schema) \
            .coalesce(1).write.mode("append").parquet(src)
    runner.run_available_now(L.streak_stream(runner.file_stream(spark, src, schema)), "append",
                             os.path.join(base, "out"), os.path.join(base, "ck"))
    got = sorted((r.date.isoformat(), r.streak_count) for r in spark.read.parquet(os.path.join(base, "out")).collect())
    assert got == [("2024-01-01", 1), ("2024-01-03", 1), ("2024-01-04", 2)]


def test_invite_notices_once_per_invitation(spark):
    """A re-delivered invitation (same id) within the watermark yields one
    notice; recipients who are not connected get none."""
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("team_id", T.LongType()),
                           T.StructField("recipient_id", T.LongType()),
                           T.StructField("created_at", T.TimestampNTZType())])
    base = runner.scratch(spark, "t-notify")
    src = os.path.join(base, "in")
    t0 = dt.datetime(2024, 1, 1, 10)
    batches = [[(1, 7, 100, t0), (2, 7, 101, t0)], [(1, 7, 100, t0 + dt.timedelta(minutes=5))],
               [(3, 8, 100, t0 + dt.timedelta(hours=1))]]
    for rows_ in batches:
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(src)
    connected = spark.createDataFrame([(100,)], "user_id long")
    stream = S.invite_notify_stream(runner.file_stream(spark, src, schema), connected)
    runner.run_available_now(stream, "append", os.path.join(base, "out"), os.path.join(base, "ck"))
    got = sorted((r.invitation_id, r.recipient_id, r.message)
                 for r in spark.read.parquet(os.path.join(base, "out")).collect())
    assert got == [(1, 100, S.INVITE_MESSAGE), (3, 100, S.INVITE_MESSAGE)]


def _replay(spark, df_, ts, build, files=4):
    """The stream over ``df_`` in event order: its rows and its progress."""
    base = runner.scratch(spark, "t-replay")
    runner.stage_in_event_order(df_, ts, os.path.join(base, "in"), min_files=files)
    per_batch = runner.files_per_batch(spark, os.path.join(base, "in"), 2)
    info = runner.run_available_now(build(runner.file_stream(spark, os.path.join(base, "in"), df_.schema, per_batch)), "append",
                                    os.path.join(base, "out"), os.path.join(base, "ck"))
    return spark.read.parquet(os.path.join(base, "out")), info["progress"]


def _state_rows(progress):
    return max(op["numRowsTotal"] for p in progress for op in p["stateOperators"])


def test_keys_share_state_rows_and_calls(spark):
    """Thousands of user-days, tokens and users make no more state rows (nor calls into Python) than there are groups; results are the batch twins'."""
    t0 = dt.datetime(2024, 1, 1)
    logs = spark.range(6000).select(
        F.col("id"), (F.col("id") % 1500).alias("user_id"), F.lit(None).cast("long").alias("activity_id"), F.lit(5).alias("duration"),
        (F.col("id") % 13).cast("int").alias("points"), F.lit("x").alias("activity_description"),
        (F.lit(t0).cast("timestamp_ntz") + F.make_dt_interval(days=F.col("id") % 3, mins=(F.col("id") * 2 + 1) % 1400)).alias("logged_at"))
    goals = logs.where("id < 1500").select("id", "user_id", F.to_date("logged_at").alias("goal_date"), F.lit(9).alias("goal_points"),
                                           F.date_trunc("day", "logged_at").cast("timestamp_ntz").alias("created_at"), F.lit("x").alias("status"))
    out, progress = _replay(spark, with_heartbeat(L.goal_events(logs, goals), "at"), "at", L.goal_stream)
    assert _goal_rows(out) == _batch_rows(logs, goals)
    assert 0 < _state_rows(progress) <= GROUPS and sum(p["numInputRows"] > 0 for p in progress) <= 2
    resets = logs.select(F.col("id").alias("token"), "user_id", F.col("logged_at").alias("created_at"),
                         (F.col("logged_at") + F.expr("INTERVAL 20 MINUTES")).alias("expires_at"))
    attempts = logs.select(F.col("id").alias("attempt_id"), F.col("id").alias("token"),
                           (F.col("logged_at") + F.make_dt_interval(mins=F.col("id") % 40)).alias("attempted_at"))
    users = logs.select(F.col("user_id").alias("id")).distinct().select("id", F.lit("u").alias("username"), F.lit("e").alias("email"), F.lit(None).cast("string").alias("google_id"))
    out, progress = _replay(spark, with_heartbeat(L.reset_events(attempts, resets, users), "at"), "at", L.reset_redeem_stream)
    key = lambda r: (r.attempt_id, r.token, r.outcome, r.email)
    assert sorted(map(key, out.collect())) == sorted(map(key, U.redeem_resets(resets, attempts, users).collect()))
    assert 0 < _state_rows(progress) <= GROUPS
    out, progress = _replay(spark, logs, "logged_at", L.streak_stream)
    assert out.count() == logs.select("user_id", F.to_date("logged_at")).distinct().count()
    assert 0 < _state_rows(progress) <= GROUPS


def test_streaks_of_a_null_user_and_logs_without_a_time(spark):
    t0 = dt.datetime(2024, 1, 1, 9)
    logs = spark.createDataFrame([(None, t0), (None, t0 + dt.timedelta(days=1)), (2**60 + 1, t0), (4, None)], "user_id long, logged_at timestamp_ntz")
    out, _ = _replay(spark, logs, "logged_at", L.streak_stream)
    assert {(r.user_id, r.date.day, r.streak_count) for r in out.collect()} == {(None, 1, 1), (None, 2, 2), (2**60 + 1, 1, 1)}
