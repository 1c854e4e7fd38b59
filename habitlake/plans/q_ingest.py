"""Registered scoring / ingestion queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions.ids import new_id_sql
from ..operators import ingest as I
from ..operators import reports as R
from ..session import ensure_checkpoint_dir
from ..sources import sinks
from ..sources.requests import ingest_requests
from . import q_reports, text_log
from .registry import END, START, register


@register("score_points", """
SELECT l.id, l.user_id, l.duration, a.points AS rate,
 CAST(round(CAST(l.duration AS DOUBLE) * (CAST(a.points AS DOUBLE) / 60.0)) AS INTEGER) AS points
FROM user_activity_logs l JOIN user_activities a ON a.id = l.activity_id""", ("user_activity_logs", "user_activities"))
def _i1(fx):
    return I.score_logs(fx.user_activity_logs, fx.user_activities)


_PAT = I.EXTRACT_PATTERN.replace("'", "''")
_EX = f"""ex AS (SELECT id, user_id, regexp_extract_all(text, '{_PAT}', 1) AS names,
   regexp_extract_all(text, '{_PAT}', 2) AS durs FROM extracted_texts),
ex2 AS (SELECT *, CASE WHEN len(names) = 0 THEN 'Invalid input'
   WHEN EXISTS (SELECT 1 FROM unnest(durs) AS t(x) WHERE try_cast(x AS BIGINT) IS NULL) THEN 'Invalid duration format'
   END AS reason
   FROM ex),
un AS (SELECT id, user_id, unnest(names) AS activity, unnest(durs) AS raw, unnest(range(len(names))) AS pos
   FROM ex2 WHERE reason IS NULL),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, activity ORDER BY pos DESC) AS rk FROM un) WHERE rk = 1),
pairs AS (SELECT id, user_id, activity, CAST(raw AS BIGINT) AS duration, CAST(pos AS INTEGER) AS pos,
   CAST(COUNT(*) OVER (PARTITION BY id) AS INTEGER) AS n_activities FROM kept)"""


@register("extract_activities", f"WITH {_EX}\nSELECT * FROM pairs", ("extracted_texts",))
def _i2(fx):
    return I.extract_activities(fx.extracted_texts)[0]


@register("extract_rejects", f"WITH {_EX}\nSELECT id, user_id, reason FROM ex2 WHERE reason IS NOT NULL",
          ("extracted_texts",))
def _i2r(fx):
    return I.extract_activities(fx.extracted_texts)[1]


_MATCH = f"""{_EX},
syn AS (SELECT lower(trim(term)) AS k, lower(trim(canonical)) AS c FROM synonyms),
hits AS (SELECT DISTINCT p.id, p.activity, a.id AS activity_id FROM pairs p JOIN user_activities a ON a.user_id = p.user_id
   WHERE lower(trim(a.name)) = lower(trim(p.activity)) OR levenshtein(lower(trim(a.name)), lower(trim(p.activity))) <= 1
   OR lower(trim(a.name)) IN (SELECT c FROM syn WHERE syn.k = lower(trim(p.activity)))),
m AS (SELECT p.*, CAST(COUNT(h.activity_id) AS INTEGER) AS n_matched,
   COALESCE(string_agg(CAST(h.activity_id AS VARCHAR), ',' ORDER BY h.activity_id), '') AS matched_ids
   FROM pairs p LEFT JOIN hits h ON h.id = p.id AND h.activity = p.activity
   GROUP BY p.id, p.user_id, p.activity, p.duration, p.pos, p.n_activities)"""
_MV = ("extracted_texts", "user_activities", "synonyms")


def _matched(fx):
    pairs = I.extract_activities(fx.extracted_texts)[0]
    return I.match_activities(pairs, fx.user_activities, fx.synonyms)


@register("match_activities", f"WITH {_MATCH}\nSELECT id, activity, n_matched, matched_ids FROM m", _MV)
def _i3(fx):
    return _matched(fx).select("id", "activity", "n_matched", F.array_join(
        F.transform("matched", lambda x: x["activity_id"].cast("string")), ",").alias("matched_ids"))


@register("classify_matches", f"""
WITH {_MATCH}
SELECT id, activity, CASE WHEN n_matched = 1 THEN 'log' WHEN n_matched > 1 THEN 'ambiguous' ELSE 'unknown' END AS outcome,
 duration, CASE WHEN n_matched = 0 THEN activity WHEN n_matched > 1 AND n_activities > 1 THEN activity END AS name, n_matched
FROM m""", _MV)
def _i4(fx):
    return I.classify_matches(_matched(fx)).select("id", "activity", "outcome", "duration", "name", "n_matched")


@register("daily_cap_admission", """
WITH RECURSIVE o AS (SELECT id, user_id, CAST(logged_at AS DATE) AS day, CAST(duration AS BIGINT) AS d,
   row_number() OVER (PARTITION BY user_id, CAST(logged_at AS DATE) ORDER BY logged_at, id) AS rn FROM user_activity_logs),
r AS (SELECT id, user_id, day, rn, d <= 1440 AS accepted, CASE WHEN d <= 1440 THEN d ELSE 0 END AS acc FROM o WHERE rn = 1
  UNION ALL
  SELECT o.id, o.user_id, o.day, o.rn, r.acc + o.d <= 1440, CASE WHEN r.acc + o.d <= 1440 THEN r.acc + o.d ELSE r.acc END
  FROM r JOIN o ON o.user_id = r.user_id AND o.day = r.day AND o.rn = r.rn + 1)
SELECT user_id, day, id, accepted, acc AS minutes_after FROM r""", ("user_activity_logs",))
def _i5(fx):
    return I.daily_cap_admission(fx.user_activity_logs).select("user_id", "day", "id", "accepted", "minutes_after")


_REQ = """req AS (SELECT r.id, e.user_id, e.ts AS logged_at, r.value, json_valid(r.value) AS ok,
   CASE WHEN json_valid(r.value) THEN json_extract_string(r.value, '$.activity_id') END AS activity_id FROM requests_json r JOIN events e ON e.event_id = r.id),
good AS (SELECT id, user_id, logged_at, activity_id, json_extract_string(value, '$.activity_name') AS activity_name,
   CAST(json_extract_string(value, '$.activity_points') AS INTEGER) AS activity_points,
   CAST(json_extract_string(value, '$.activity_duration') AS INTEGER) AS activity_duration,
   json_extract_string(value, '$.activity_description') AS activity_description,
   json_extract_string(value, '$.one_time') AS one_time
   FROM req WHERE ok AND (activity_id IS NULL OR regexp_full_match(activity_id, '[0-9]+')))"""


def _requests(fx):
    ev = fx.events.select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("logged_at"))
    return ingest_requests(fx.requests_json.join(ev, "id"), I.LOG_REQUEST_SCHEMA)


@register("ingest_requests", f"WITH {_REQ}\nSELECT * FROM good", ("requests_json",))
def _s3(fx):
    return _requests(fx)[0]


@register("ingest_requests_quarantine", f"""
WITH {_REQ}
SELECT id, user_id, logged_at, value, CASE WHEN NOT ok THEN 'decode error' ELSE 'bad id' END AS reason FROM req
WHERE NOT ok OR (activity_id IS NOT NULL AND NOT regexp_full_match(activity_id, '[0-9]+'))""", ("requests_json",))
def _s3q(fx):
    return _requests(fx)[1]


_KIND = ("CASE WHEN activity_id IS NOT NULL THEN 'specific' WHEN one_time = 'true' THEN 'one_time' ELSE 'new' END")


@register("ingest_logs", f"""
WITH {_REQ}, k AS (SELECT *, {_KIND} AS kind FROM good)
SELECT {new_id_sql('log', 'id')} AS id, id AS request_id, user_id, CASE WHEN kind = 'specific' THEN activity_id
  WHEN kind = 'new' THEN {new_id_sql('activity', 'id')} END AS activity_id,
 activity_duration AS duration,
 CAST(round(CAST(activity_duration AS DOUBLE) * (CAST(activity_points AS DOUBLE) / 60.0)) AS INTEGER) AS points,
 activity_description, logged_at, kind FROM k""", ("requests_json",))
def _i6(fx):
    return I.ingest_structured_logs(_requests(fx)[0])[1]


@register("ingest_new_activities", f"""
WITH {_REQ}, k AS (SELECT *, {_KIND} AS kind FROM good)
SELECT {new_id_sql('activity', 'id')} AS id, user_id, activity_name AS name, activity_points AS points,
 'custom' AS activity_type FROM k WHERE kind = 'new'""", ("requests_json",))
def _i6a(fx):
    return I.ingest_structured_logs(_requests(fx)[0])[0]


@register("seed_default_catalog", f"""
SELECT {new_id_sql('default_activity', 'u.id', 'r.k')} AS id, u.id AS user_id, r.name, r.points, 'default' AS activity_type
FROM users u, activity_rates r WHERE u.google_id IS NULL""", ("users", "activity_rates"))
def _i8(fx):
    return I.seed_default_catalog(fx.users.withColumn("set_default", F.col("google_id").isNull()))


def _texts(fx):
    ev = fx.events.select(F.col("event_id").alias("id"), F.col("ts").alias("logged_at"))
    return fx.extracted_texts.join(ev, "id")


def _text_logs(fx):
    return text_log.log_from_texts(_texts(fx), fx.user_activities, fx.user_activity_logs, fx.synonyms)


_I7 = f"""WITH RECURSIVE {_MATCH},
cand AS (SELECT {new_id_sql('text_log', 'm.id', 'm.pos')} AS id, true AS is_new, m.id AS text_id, m.pos, m.user_id, h.activity_id,
   CAST(m.duration AS INTEGER) AS duration,
   CAST(round(CAST(m.duration AS DOUBLE) * (CAST(a.points AS DOUBLE) / 60.0)) AS INTEGER) AS points,
   t.text AS activity_description, e.ts AS logged_at
   FROM m JOIN hits h ON h.id = m.id AND h.activity = m.activity JOIN user_activities a ON a.id = h.activity_id
   JOIN extracted_texts t ON t.id = m.id JOIN events e ON e.event_id = m.id WHERE m.n_matched = 1),
cdays AS (SELECT DISTINCT user_id, CAST(logged_at AS DATE) AS day FROM cand),
allrows AS (SELECT id, is_new, text_id, pos, user_id, logged_at, CAST(duration AS BIGINT) AS d, false AS forced FROM cand
   UNION ALL SELECT CAST(l.id AS VARCHAR), false, l.id, 0, l.user_id, l.logged_at, CAST(l.duration AS BIGINT), true FROM user_activity_logs l
   JOIN cdays c ON c.user_id = l.user_id AND c.day = CAST(l.logged_at AS DATE)),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(logged_at AS DATE) ORDER BY logged_at, is_new, text_id, pos) AS rn,
   CAST(logged_at AS DATE) AS day FROM allrows),
r AS (SELECT id, user_id, day, rn, forced OR d <= 1440 AS accepted, CASE WHEN forced OR d <= 1440 THEN d ELSE 0 END AS acc
   FROM o WHERE rn = 1
  UNION ALL
  SELECT o.id, o.user_id, o.day, o.rn, o.forced OR r.acc + o.d <= 1440,
   CASE WHEN o.forced OR r.acc + o.d <= 1440 THEN r.acc + o.d ELSE r.acc END
  FROM r JOIN o ON o.user_id = r.user_id AND o.day = r.day AND o.rn = r.rn + 1)"""
_I7_COLS = "c.id, c.user_id, c.activity_id, c.duration, c.points, c.activity_description, c.logged_at"
_I7_SQL = f"{_I7}\nSELECT {_I7_COLS} FROM cand c JOIN r ON r.id = c.id WHERE r.accepted"
_I7_VIEWS = _MV + ("user_activity_logs",)


@register("text_log_accepted", _I7_SQL, _I7_VIEWS)
def _i7(fx):
    return _text_logs(fx)["accepted"]


@register("text_log_over_cap", f"""{_I7}
SELECT {_I7_COLS}, r.acc AS minutes_after FROM cand c JOIN r ON r.id = c.id WHERE NOT r.accepted""", _I7_VIEWS)
def _i7c(fx):
    return _text_logs(fx)["over_cap"]


@register("text_log_responses", f"""
WITH {_MATCH},
cls AS (SELECT m.*, CASE WHEN n_matched = 1 THEN 'log' WHEN n_matched > 1 THEN 'ambiguous' ELSE 'unknown' END AS outcome,
   CASE WHEN n_matched = 0 THEN activity WHEN n_matched > 1 AND n_activities > 1 THEN activity END AS name
   FROM m),
items AS (SELECT c.id, c.user_id, c.pos, c.n_activities,
   '{{"matched_activities":' || COALESCE((SELECT to_json(list(json_object('activity_id', a.id, 'name', a.name,
       'points', a.points, 'type', a.activity_type) ORDER BY a.id)) FROM hits h JOIN user_activities a
       ON a.id = h.activity_id WHERE h.id = c.id AND h.activity = c.activity), 'null')
   || CASE WHEN r.rest = '' THEN '}}' ELSE ',' || r.rest || '}}' END AS j
   FROM cls c JOIN extracted_texts t ON t.id = c.id,
   LATERAL (SELECT concat_ws(',',
     CASE WHEN c.outcome <> 'log' AND c.duration <> 0 THEN '"duration":' || CAST(c.duration AS VARCHAR) END,
     CASE WHEN c.outcome <> 'log' AND t.text <> '' THEN '"description":' || to_json(t.text) END,
     CASE WHEN c.name <> '' THEN '"name":' || to_json(c.name) END) AS rest) r)
SELECT id, user_id, CASE WHEN MAX(n_activities) = 1 THEN MAX(j)
  ELSE '{{"activity_logs":[' || string_agg(j, ',' ORDER BY pos) || ']}}' END AS json
FROM items GROUP BY id, user_id""", _MV)
def _s4l(fx):
    return text_log.text_log_responses(fx.extracted_texts, fx.user_activities, fx.synonyms)


_D = "strftime({}, '%Y-%m-%dT00:00:00Z')"


@register("report_json", f"""
WITH {q_reports._PPD}, r1 AS ({q_reports._R1}), r2 AS ({q_reports._R2}), r3 AS ({q_reports._R3}), r4 AS ({q_reports._R4}),
days AS (SELECT user_id, to_json(list(json_object('date', {_D.format('date')}, 'total_points', total_points,
   'status', status) ORDER BY date, status)) AS arr FROM r3 GROUP BY user_id)
SELECT r1.user_id, CASE WHEN days.arr IS NULL THEN '[]' ELSE CAST(json_object(
  'productivity_points', json_object('total_points', CAST(r1.total_points AS VARCHAR),
     'average_points', printf('%.2f', r1.average_points_per_day)),
  'best_productivity_day', json_object('date', {_D.format('r2.date')}, 'total_points', r2.total_points),
  'productivity_days', days.arr,
  'time', json_object('productive_time', r4.productive_time, 'unproductive_time', r4.unproductive_time))
  AS VARCHAR) END AS json
FROM r1 LEFT JOIN r2 ON r2.user_id = r1.user_id LEFT JOIN days ON days.user_id = r1.user_id
LEFT JOIN r4 ON r4.user_id = r1.user_id""", ("users", "user_activity_logs", "user_goals"))
def _s4r(fx):
    return sinks.to_report_json(R.productivity_report(fx.user_activity_logs, fx.user_goals, fx.users, START, END))


@register("append_logs", f"""{_I7}
SELECT {_I7_COLS}, CAST(c.logged_at AS DATE) AS log_date FROM cand c JOIN r ON r.id = c.id WHERE r.accepted""",
          _I7_VIEWS)
def _s2(fx):
    """Write the accepted text logs to a fresh folder under the shared
    checkpoint location, twice as after a lost writer, and read them back
    with partition discovery."""
    base = ensure_checkpoint_dir(fx.spark)
    path = os.path.join(base, "habitlake-append", uuid.uuid4().hex)
    for _ in range(2):
        sinks.append_logs(_text_logs(fx)["accepted"], path, "texts")
    return sinks.read_logs(fx.spark, path)
