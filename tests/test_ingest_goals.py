"""Ingestion, goals and seeded property tests against plain Python loops."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from helpers import ACTS, GOALS, LOGS, df, log, rows, ts

from habitlake.operators import goals as G
from habitlake.operators import ingest as I
from habitlake.operators import streaks as S
from habitlake.sources import sinks
from habitlake.sources.requests import ingest_requests

TEXT_T = "id long, user_id long, text string"


def test_extract_duplicates_bad_duration_trailing_space(spark):
    texts = df(spark, [(1, 1, "Activity1:Studying,Duration1:10,Activity2:Studying,Duration2:25"),
                       (2, 1, "Activity: Chess , Duration: 5"),
                       (3, 1, "Activity: Go, Duration: 99999999999999999999"),
                       (4, 1, "nothing here")], TEXT_T)
    good, bad = I.extract_activities(texts)
    assert rows(good, "id", "activity", "duration", "n_activities") == [(1, "Studying", 25, 1), (2, "Chess ", 5, 1)]
    assert rows(bad, "id", "reason") == [(3, "Invalid duration format"), (4, "Invalid input")]


def test_match_and_classify(spark):
    acts = df(spark, [(10, 1, "Exercise", 8, "default"), (11, 1, "Learning", 10, "default"),
                      (12, 1, "Reading", 4, "default")], ACTS)
    syn = df(spark, [("running", "exercise"), ("studying", "learning"), ("studying", "reading")],
             "term string, canonical string")
    texts = df(spark, [(1, 1, "Activity: running, Duration: 5"),
                       (2, 1, "Activity1:Studying,Duration1:10,Activity2:Chess,Duration2:3"),
                       (3, 1, "Activity: Studying, Duration: 7"),
                       (4, 1, "Activity: Readng, Duration: 9")], TEXT_T)
    pairs, _ = I.extract_activities(texts)
    cls = I.classify_matches(I.match_activities(pairs, acts, syn))
    got = rows(cls, "id", "activity", "outcome", "name", "n_matched")
    assert got == [(1, "running", "log", None, 1), (2, "Chess", "unknown", "Chess", 0),
                   (2, "Studying", "ambiguous", "Studying", 2), (3, "Studying", "ambiguous", None, 2),
                   (4, "Readng", "log", None, 1)]
    resp = {r.id: json.loads(r.json) for r in sinks.to_log_responses(cls, texts).collect()}
    assert resp[1] == {"matched_activities": [{"activity_id": 10, "name": "Exercise", "points": 8,
                                               "type": "default"}]}
    assert set(resp[3]) == {"matched_activities", "duration", "description"}
    assert [x["matched_activities"] is None for x in resp[2]["activity_logs"]] in ([True, False], [False, True])


def _cap_loop(items, cap=1440):
    out, acc = {}, {}
    for at, i, user, dur in sorted(items, key=lambda x: (x[0], x[1])):
        k = (user, at.date())
        a = acc.get(k, 0)
        ok = a + dur <= cap
        acc[k] = a + dur if ok else a
        out[i] = (ok, acc[k])
    return out


def test_cap_admission_matches_loop(spark):
    rnd = random.Random(7)
    items = []
    for i in range(400):
        at = dt.datetime(2024, 1, 1 + rnd.randrange(3), rnd.randrange(24), rnd.randrange(60))
        items.append((at, i, rnd.randrange(4), rnd.choice([0, 5, 60, 300, 700, 1500])))
    logs = df(spark, [(i, u, None, dur, 0, "x", at) for at, i, u, dur in items], LOGS)
    got = {r.id: (r.accepted, r.minutes_after) for r in I.daily_cap_admission(logs).collect()}
    assert got == _cap_loop(items)


def test_cap_hit_then_smaller_fits(spark):
    logs = df(spark, [log(1, 1, 1400, 0, "2024-01-01 01:00:00"), log(2, 1, 100, 0, "2024-01-01 02:00:00"),
                      log(3, 1, 40, 0, "2024-01-01 03:00:00")], LOGS)
    assert rows(I.daily_cap_admission(logs), "id", "accepted") == [(1, True), (2, False), (3, True)]


def _flips_loop(logs, goal, goal_at, mode):
    out, total = [], 0
    for at, i, p in sorted(logs):
        total += p
        if goal > 0 and at >= goal_at:
            a = total
            if mode == "reference":
                done, undone = a + p > goal and not a > goal, goal > a + p and a > goal
            else:
                done, undone = a > goal and a - p <= goal, a < goal and a - p > goal
            if done:
                out.append((i, "completed"))
            elif undone:
                out.append((i, "uncompleted"))
    return out


def test_goal_transitions_match_loop(spark):
    rnd = random.Random(3)
    logs = [(dt.datetime(2024, 1, 5, rnd.randrange(24), rnd.randrange(60), rnd.randrange(60)), i,
             rnd.randrange(-9, 10)) for i in range(60)]
    goal_at = dt.datetime(2024, 1, 5, 6)
    ldf = df(spark, [(i, 1, None, 10, p, "x", at) for at, i, p in logs], LOGS)
    gdf = df(spark, [(1, 1, dt.date(2024, 1, 5), 12, goal_at, "not completed")], GOALS)
    for mode in ("reference", "intent"):
        got = rows(G.goal_transitions(ldf, gdf, mode), "id", "transition")
        assert got == sorted(_flips_loop(logs, 12, goal_at, mode))


def test_goal_status_and_reminders(spark):
    ldf = df(spark, [log(1, 1, 10, 10, "2024-01-05 10:00:00"), log(2, 1, 10, 1, "2024-01-05 13:00:00")], LOGS)
    gdf = df(spark, [(1, 1, dt.date(2024, 1, 5), 15, ts("2024-01-05 06:00:00"), "not completed")], GOALS)
    # reference mode counts the log twice: 10 + 10 > 15 flips on the first log
    t = G.goal_transitions(ldf, gdf, "reference")
    assert rows(t, "id", "transition") == [(1, "completed")]
    assert rows(G.goal_status(gdf, t), "goal_id", "status") == [(1, "completed")]
    # tracker from 06:00: ticks 09:00 (0 points), then the 10:00 completion stops it
    rem = rows(G.goal_reminders(gdf, t, ldf), "tick_at", "total_points", "goal_points")
    assert rem == [(ts("2024-01-05 09:00:00"), 0, 15)]


def test_streaks_match_brute_force(spark):
    rnd = random.Random(11)
    days = sorted({dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(40)) for _ in range(25)})
    logs = df(spark, [(i, 1, None, 1, 1, "x", dt.datetime.combine(x, dt.time(12))) for i, x in enumerate(days)],
              LOGS)
    cur = longest = 0
    prev = None
    for x in days:
        cur = cur + 1 if prev is not None and (x - prev).days == 1 else 1
        longest = max(longest, cur)
        prev = x
    assert rows(S.streaks(logs), "current_streak", "longest_streak", "last_logged_date") == [(cur, longest, days[-1])]


def test_requests_quarantine(spark):
    req = df(spark, [(1, '{"activity_name":"a","activity_points":6,"activity_duration":30,"one_time":"true"}'),
                     (2, '{"activity_name": 5'),
                     (3, '{"activity_id":"x1","activity_name":"b"}'),
                     (4, '{"activity_id":"12","activity_points":6,"activity_duration":10}')], "id long, value string")
    good, bad = ingest_requests(req, I.LOG_REQUEST_SCHEMA)
    assert rows(bad, "id", "reason") == [(2, "decode error"), (3, "bad id")]
    g = good.withColumn("user_id", good.id).withColumn("logged_at", F.lit(ts("2024-01-01 00:00:00")))
    new_acts, logs = I.ingest_structured_logs(g)
    assert rows(logs, "request_id", "kind", "activity_id", "points") == [(1, "one_time", None, 3), (4, "specific", "12", 1)]
    assert new_acts.count() == 0


def test_cap_admission_of_large_days_matches_loop(spark):
    """User-days of more than 10,000 logs with forced rows beyond the cap and
    negative durations, over many batches, against a plain loop."""
    rnd = random.Random(5)
    items, forced = [], set()
    for i in range(25_000):
        at = dt.datetime(2024, 1, 1 + i // 24_000, rnd.randrange(24), rnd.randrange(60), rnd.randrange(60))
        items.append((at, i, rnd.randrange(2), rnd.choice([0, 5, 60, 300, -700, -90, 1500])))
        if rnd.random() < 0.1:
            forced.add(i)
    logs = df(spark, [(i, u, at, dur, i in forced) for at, i, u, dur in items],
              "id long, user_id long, logged_at timestamp_ntz, duration int, forced boolean")
    got = {r.id: (r.accepted, r.minutes_after) for r in I.daily_cap_admission(logs).collect()}
    want, acc = {}, {}
    for at, i, u, dur in sorted(items, key=lambda x: (x[0], x[1])):
        k = (u, at.date())
        a = acc.get(k, 0)
        ok = i in forced or a + dur <= 1440
        acc[k] = a + dur if ok else a
        want[i] = (ok, acc[k])
    assert got == want


def test_cap_counts_stored_minutes_beyond_it(spark):
    """Stored 2000 minutes, then -100, then 90: both later logs stay over the cap."""
    logs = df(spark, [(1, 1, ts("2024-01-01 01:00:00"), 2000, True), (2, 1, ts("2024-01-01 02:00:00"), -100, False),
                      (3, 1, ts("2024-01-01 03:00:00"), 90, False), (4, 1, ts("2024-01-02 00:00:00"), None, False),
                      (5, 1, ts("2024-01-02 00:00:00"), 1440, None), (6, None, None, 1441, None)],
              "id long, user_id long, logged_at timestamp_ntz, duration int, forced boolean")
    assert rows(I.daily_cap_admission(logs), "id", "accepted", "minutes_after") == \
        [(1, True, 2000), (2, False, 2000), (3, False, 2000), (4, True, 0), (5, True, 1440), (6, False, 0)]


def test_new_ids_do_not_collide(spark):
    """Neighbouring requests and places, kinds, and parts that join to the same text."""
    from habitlake.functions.ids import new_id
    pairs = df(spark, [(a, b) for a in [1, 2, 7, 10, 11, 73, 105, 205] for b in [1, 2, 3, 5, 11, 13, 105]], "a long, b long")
    ids = pairs.select(F.explode(F.array(new_id("x", "a", "b"), new_id("y", "a", "b"), new_id("x1", "a", "b"))).alias("id"))
    assert ids.distinct().count() == ids.count() == 3 * 56
    assert ids.where(F.length("id") != 32).isEmpty()


def test_goal_exactly_met_is_not_completed(spark):
    """Points equal to the goal do not complete it (strictly greater), in
    both modes; one more point does."""
    ldf = df(spark, [log(1, 1, 10, 15, "2024-01-05 10:00:00"), log(2, 1, 10, 1, "2024-01-05 11:00:00")], LOGS)
    gdf = df(spark, [(1, 1, dt.date(2024, 1, 5), 15, ts("2024-01-05 06:00:00"), "not completed")], GOALS)
    assert rows(G.goal_transitions(ldf, gdf, "intent"), "id", "transition") == [(2, "completed")]
    # reference mode adds the log's points twice: 15 + 15 > 15 already flips on the first log
    assert rows(G.goal_transitions(ldf, gdf, "reference"), "id", "transition") == [(1, "completed")]


def test_structured_logs_replay_same_ids(spark):
    """'new' requests create a custom activity; ids derive from the request,
    so replaying the batch writes identical rows."""
    req = df(spark, [(5, 1, ts("2024-01-01 10:00:00"), None, "Chess", 6, 30, "d", "false"),
                     (6, 1, ts("2024-01-01 11:00:00"), None, "x", 12, 10, "d", "true")],
             "id long, user_id long, logged_at timestamp_ntz, activity_id string, activity_name string, "
             "activity_points int, activity_duration int, activity_description string, one_time string")
    a1, l1 = I.ingest_structured_logs(req)
    a2, l2 = I.ingest_structured_logs(req)
    made = a1.first()
    assert rows(a1, "id", "name", "activity_type") == rows(a2, "id", "name", "activity_type") == \
        [(made["id"], "Chess", "custom")]
    assert rows(l1, "id") == rows(l2, "id") and len(set(rows(l1, "id"))) == 2
    assert rows(l1, "request_id", "activity_id", "points", "kind") == rows(l2, "request_id", "activity_id", "points", "kind") == \
        [(5, made["id"], 3, "new"), (6, None, 2, "one_time")]


def test_empty_documents_and_wide_ids_are_quarantined(spark):
    req = df(spark, [(1, ""), (2, None), (3, "  "), (4, '{"activity_id": "99999999999999999999"}'), (5, '{"activity_id": "7"}')], "id long, value string")
    good, bad = ingest_requests(req, I.LOG_REQUEST_SCHEMA)
    assert rows(good, "id") == [(5,)]
    assert rows(bad, "id", "reason") == [(1, "decode error"), (2, "decode error"), (3, "decode error"), (4, "bad id")]


def test_matching_finds_all_names_within_the_edits(spark):
    """The index against comparing every pair: short and empty names, spaces, repeats, other users, up to two edits."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abé ") for _ in range(rnd.randrange(7)))
    acts = df(spark, [(i, rnd.randrange(3), word(), i, "custom") for i in range(150)], ACTS)
    pairs = {(i % 40, rnd.choice([word(), "Run", "x" * 3000])): i % 3 for i in range(160)}
    ext = df(spark, [(i, u, a, 10, 0, 1) for (i, a), u in pairs.items()],
             "id long, user_id long, activity string, duration long, pos int, n_activities int")
    syn = df(spark, [("run", "ab"), ("RUN ", "a"), ("b", "zzz")], "term string, canonical string")
    for edits in (0, 1, 2):
        got = {(r.id, r.activity): [m.activity_id for m in r.matched] for r in I.match_activities(ext, acts, syn, edits).collect()}
        both = ext.alias("e").join(acts.alias("c"), "user_id").select("e.id", "activity", F.col("c.id").alias("a"), F.lower(F.trim("activity")).alias("k"), F.lower(F.trim("name")).alias("n"))
        ok = (F.levenshtein("k", "n") <= edits) | ((F.col("k") == "run") & F.col("n").isin("ab", "a")) | ((F.col("k") == "b") & (F.col("n") == "zzz"))
        want = {k: [] for k in pairs}
        for r in both.where(ok).collect():
            want[r.id, r.activity].append(r.a)
        assert got == {k: sorted(v) for k, v in want.items()}


def test_matching_is_one_equi_join(spark, fx):
    from test_plans import plan
    pairs = I.extract_activities(fx.extracted_texts)[0]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(I.match_activities(pairs, fx.user_activities, fx.synonyms))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "NestedLoop" not in text and "Cartesian" not in text and "BroadcastExchange" not in text


def test_append_is_idempotent_after_a_lost_writer(spark, tmp_path):
    """A batch that failed half way and one that is written twice leave one copy; other batches stay."""
    import pytest
    path = str(tmp_path / "logs")
    make = lambda ids: df(spark, [log(i, 1, 5, 1, f"2024-01-0{1 + i % 3} 10:00:00") for i in ids], LOGS)
    sinks.append_logs(make(range(6)), path, "a")
    broken = make(range(6, 12)).withColumn("duration", F.when(F.col("id") == 11, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("duration")))
    with pytest.raises(Exception, match="lost"):
        sinks.append_logs(broken, path, "b")
    sinks.append_logs(make(range(6, 12)), path, "b")
    sinks.append_logs(make(range(6, 12)), path, "b")
    sinks.append_logs(make(range(6)), path, "a")
    out = sinks.read_logs(spark, path)
    assert rows(out, "id") == [(i,) for i in range(12)] and "batch_id" not in out.columns
    day = out.where("log_date = DATE '2024-01-02'")
    assert rows(day, "id") == [(1,), (4,), (7,), (10,)]
    from test_plans import plan
    assert "PartitionFilters: [isnotnull(log_date" in plan(day)


def test_goal_dates_are_the_ones_written(spark):
    """Any offset and fraction; bad days, months, hours and layouts are rejected."""
    good = {"2024-01-15T00:30:00+02:00": "2024-01-15", "2024-01-15T23:30:00-11:30": "2024-01-15", "2024-02-29T10:00:00.123456Z": "2024-02-29",
            "2024-01-15T10:00:00.1Z": "2024-01-15", "2024-12-31T23:59:59.999999999+14:00": "2024-12-31"}
    bad = ["", "2024-01-15", "2024-02-30T10:00:00Z", "2024-01-15T25:00:00Z", "2024-01-15 10:00:00Z", "2024-01-15T10:00:00", "2024-01-15T10:00:00.Z", "x2024-01-15T10:00:00Z", None]
    req = df(spark, [(i, 1, g, 5, ts("2024-01-01 00:00:00")) for i, g in enumerate([*good, *bad])],
             "id long, user_id long, goal_date string, goal_points int, requested_at timestamp_ntz")
    goals, rejects = G.set_goals(req)
    assert rows(goals, "id", "goal_date") == [(i, dt.date.fromisoformat(x)) for i, x in enumerate(good.values())]
    assert rows(rejects, "id") == [(i,) for i in range(len(good), len(good) + len(bad))]


def test_a_users_name_is_matched_once_however_often_it_is_logged(spark):
    """Matching runs on distinct names of a user, and once in the text path; each row keeps its own user's matches."""
    from habitlake.operators import ingest as I
    from habitlake.plans import text_log
    acts = spark.createDataFrame([(10, 1, "Reading", 4, "default"), (11, 1, "readings", 2, "custom"), (20, 2, "Reading", 9, "default")],
                                 "id long, user_id long, name string, points int, activity_type string")
    syn = spark.createDataFrame([("Studying", "Reading")], "term string, canonical string")
    ex = spark.createDataFrame([(i, 1 + i % 3, " Reading" if i % 2 else "Studying", 5, 0, 1) for i in range(30)] + [(99, None, "Reading", 5, 0, 1)],
                               "id long, user_id long, activity string, duration long, pos int, n_activities int")
    got = {(r.id, r.user_id): (r.n_matched, [m.activity_id for m in r.matched]) for r in I.match_activities(ex, acts, syn).collect()}
    assert len(got) == 31 and got[99, None] == (0, [])
    assert all(v == ((2, [10, 11]) if u == 1 and i % 2 else (1, [10]) if u == 1 else (1, [20]) if u == 2 else (0, [])) for (i, u), v in got.items())
    logs = spark.createDataFrame([], "id long, user_id long, duration int, logged_at timestamp_ntz")
    texts = spark.createDataFrame([(1, 1, "Activity: Reading, Duration: 5")], "id long, user_id long, text string").selectExpr("*", "TIMESTAMP_NTZ '2024-01-01 10:00:00' AS logged_at")
    plan = text_log.log_from_texts(texts, acts, logs, syn)["accepted"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner, (((") + plan.count("levenshtein") <= 2 and plan.count("levenshtein") == 1
