"""Application tables derived from the driver's parquet tables.

The reference ships no data. Each view below builds one of its tables from
the TPC-H-ish tables by key arithmetic only, so Spark and the DuckDB oracle
build identical rows. A view is written once in Spark SQL, with its inputs
as ``{placeholders}``; :func:`duckdb_text` renders the same view for DuckDB.

Modulo arithmetic in these views only *derives values* (which activity,
which text shape, which team); rows are selected by attributes of the data
(event type, order status, market segment), never by id arithmetic.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .tables import BASE_SCHEMAS, read_table

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's: the default activity catalog
# (name, points per hour) seeded for every new user, in the reference order.
DEFAULT_CATALOG = [
    ("Learning", 10), ("Exercise", 8), ("Meditation", 6), ("Reading", 4),
    ("Household Chores", 2), ("Watching Series", -2), ("Watching TV", -4),
    ("Gaming", -6), ("Social Media Scrolling", -8), ("Watching adult websites", -10),
]
# Role names of the fixture teams (TPC-H order priorities plus
# the reference's built-in 'owner' role).
FIXTURE_ROLES = ["owner", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
# The example associations the reference's matching prompt
# lists (extracted activity, catalog activity), as written there.
PROMPT_SYNONYMS = [
    ("Running", "Exercise"), ("Studying", "Learning"), ("Watching Netflix", "Watching Series"),
    ("Cleaning the house", "Household Chores"), ("Scrolling on Instagram", "Social Media Scrolling"),
]
# Test data only: one more association so a name can match two catalog
# entries (the ambiguous case). Matching lower-cases and trims both sides.
SYNONYMS = PROMPT_SYNONYMS + [("Studying", "Reading")]
# Fixed request frame for user search (search_id, q, team_id, caller_id).
SEARCHES = [(0, "00001", 3, 10), (1, "99", 7, 99), (2, "_4%2", 1, 42),
            (3, "CUSTOMER", 0, 0), (4, "zzz", 2, 5)]
# ---------------------------------------------------------------------------


def _values(rows, cols) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)
    body = ",".join("(" + ",".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({','.join(cols)})"


VIEWS: dict[str, str] = {
    "users": """
SELECT c_custkey AS id, c_name AS username, lower(concat(c_name,'@example.org')) AS email,
 CASE WHEN c_custkey % 4 = 0 THEN concat('g-', CAST(c_custkey AS STRING)) END AS google_id,
 CASE WHEN c_custkey % 4 <> 0 OR c_mktsegment = 'BUILDING' THEN concat('hash-', CAST(c_custkey AS STRING)) END AS password_hash
FROM {customer}""",
    "activity_rates": _values([(k, n, p) for k, (n, p) in enumerate(DEFAULT_CATALOG)],
                              ["k", "name", "points"]),
    "role_names": _values(list(enumerate(FIXTURE_ROLES)), ["k", "role_name"]),
    "user_activities": """
SELECT u.user_id*10 + r.k AS id, u.user_id, r.name, r.points, 'default' AS activity_type
FROM (SELECT user_id, explode(sequence(0, 9)) AS k FROM (SELECT DISTINCT user_id FROM {events})) u
JOIN {activity_rates} r ON r.k = u.k""",
    "user_activity_logs": """
SELECT e.event_id AS id, e.user_id,
 CASE WHEN e.event_id % 11 = 10 THEN NULL ELSE e.user_id*10 + e.event_id % 11 END AS activity_id,
 CAST(floor(e.value*4) AS INT) AS duration,
 CAST(round(CAST(floor(e.value*4) AS DOUBLE) * (CAST(coalesce(r.points, CAST(e.event_id % 7 AS INT) - 3) AS DOUBLE) / 60e0)) AS INT) AS points,
 e.event_type AS activity_description, e.ts AS logged_at
FROM {events} e LEFT JOIN {activity_rates} r ON r.k = e.event_id % 11""",
    # users set a goal on the days they click; users with id % 10 = 0 set two
    "user_goals": """
SELECT d.user_id*100 + day(d.dt) + d.n*1000000 AS id, d.user_id, d.dt AS goal_date,
 CAST((d.user_id % 5)*5 AS INT) AS goal_points, CAST(d.dt AS TIMESTAMP_NTZ) + INTERVAL 6 HOURS AS created_at,
 CASE WHEN (d.user_id + day(d.dt) + d.n) % 2 = 0 THEN 'completed' ELSE 'not completed' END AS status
FROM (SELECT user_id, dt, explode(sequence(0, CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END)) AS n
      FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS dt FROM {events} WHERE event_type = 'click')) d""",
    "teams": """
SELECT n_nationkey AS id, n_name AS name, r_name AS team_industry, 5 + n_nationkey % 4 AS team_size,
 n_nationkey % 2 = 0 AS is_private, n_nationkey AS created_by
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "team_memberships": """
SELECT DISTINCT o.o_custkey*100 + s.s_nationkey AS id, s.s_nationkey AS team_id, o.o_custkey AS user_id
FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey JOIN {supplier} s ON s.s_suppkey = l.l_suppkey""",
    "team_roles": """
SELECT n.n_nationkey*10 + r.k AS id, r.role_name, n.n_nationkey AS team_id
FROM (SELECT n_nationkey, explode(sequence(0, 5)) AS k FROM {nation}) n JOIN {role_names} r ON r.k = n.k""",
    # a member's roles: the priorities of the user's two latest orders (and
    # 'owner' where user_id % 25 is the team); HOUSEHOLD customers hold none
    "team_user_roles": """
SELECT DISTINCT tm.id*10 + tr.id % 10 AS id, tm.id AS team_membership_id, tr.id AS role_id
FROM {team_memberships} tm JOIN {customer} c ON c.c_custkey = tm.user_id AND c.c_mktsegment <> 'HOUSEHOLD'
JOIN (SELECT o_custkey, o_orderpriority,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM {orders}) o
 ON o.o_custkey = tm.user_id AND o.rn <= 2
JOIN {team_roles} tr ON tr.team_id = tm.team_id
 AND (tr.role_name = o.o_orderpriority OR (tr.role_name = 'owner' AND tm.user_id % 25 = tm.team_id))""",
    "team_activities": """
SELECT p_partkey AS id, p_partkey % 25 AS team_id, p_name AS activity_name, p_size - 25 AS points,
 DATE '2024-01-01' + CAST(p_partkey % 400 AS INT) AS created_at,
 DATE '2024-01-01' + CAST(p_partkey % 400 + p_size AS INT) AS updated_at,
 CASE p_partkey % 4 WHEN 0 THEN array() WHEN 1 THEN array('1-URGENT') WHEN 2 THEN array('2-HIGH','3-MEDIUM')
  ELSE array('5-LOW','2-HIGH','1-URGENT') END AS activity_roles
FROM {part}""",
    # work that team members logged, and activities they asked for
    "team_activity_logs": """
SELECT event_id AS id, user_id % 27 AS team_id, user_id, event_type AS activity_name, CAST(floor(value) AS INT) - 40 AS points, ts AS logged_at
FROM {events} WHERE event_type = 'purchase'""",
    "team_activity_requests": """
SELECT event_id AS id, user_id % 25 AS team_id, user_id, event_type AS activity_name, CAST(floor(value) AS INT) % 10 AS points, ts AS created_at
FROM {events} WHERE event_type = 'error'""",
    "team_invitations": """
SELECT o_orderkey AS id, o_orderkey % 25 AS team_id, o_orderkey % 97 AS sender_id, o_custkey AS recipient_id,
 'pending' AS status, o_orderdate AS created_at, o_orderstatus = 'F' AS seen
FROM {orders}""",
    "suggestion_votes": """
SELECT event_id, event_id % 40 AS suggestion_id,
 CASE WHEN event_type IN ('view','click','signup') THEN 1 ELSE -1 END AS delta, ts
FROM {events} WHERE event_type <> 'purchase'""",
    "password_reset": """
SELECT event_id AS token, user_id, ts AS created_at, ts + INTERVAL 20 MINUTES AS expires_at
FROM {events} WHERE event_type = 'signup'""",
    "suggestions": """
SELECT p_partkey AS id, p_name AS title, p_type AS description, CAST(p_partkey % 97 AS BIGINT) AS user_id, 0 AS upvote
FROM {part}""",
    "reset_attempts": """
SELECT e.event_id AS attempt_id, CASE WHEN e.event_id % 5 = 0 THEN -e.event_id ELSE max(p.token) END AS token,
 e.ts AS attempted_at
FROM {events} e JOIN {password_reset} p
 ON p.user_id = e.user_id AND e.ts > p.created_at AND e.ts < p.created_at + INTERVAL 3 HOURS
WHERE e.event_type <> 'signup' GROUP BY e.event_id, e.ts""",
    "extracted_texts": """
SELECT e.event_id AS id, e.user_id,
 CASE WHEN e.event_id % 13 = 0 THEN 'no activity found'
  WHEN e.event_id % 17 = 0 THEN concat('Activity: ', coalesce(r.name,'Chess'), ', Duration: 99999999999999999999')
  WHEN e.event_id % 3 = 0 THEN concat('Activity1:', coalesce(r.name,'Chess'), ',Duration1:', CAST(CAST(floor(e.value) AS INT) AS STRING), ',Activity2:Running,Duration2:30')
  WHEN e.event_id % 7 = 0 THEN concat('Activity1:Studying,Duration1:10,Activity2:Studying,Duration2:', CAST(CAST(floor(e.value) AS INT) AS STRING))
  ELSE concat('Activity: ', coalesce(r.name,'Chess'), ', Duration: ', CAST(CAST(floor(e.value) AS INT) AS STRING)) END AS text
FROM {events} e LEFT JOIN {activity_rates} r ON r.k = e.event_id % 11""",
    "synonyms": _values(SYNONYMS, ["term", "canonical"]),
    "searches": _values(SEARCHES, ["search_id", "q", "team_id", "caller_id"]),
    # request frame: every customer asks about the team of its nation
    "pairs": """
SELECT c_custkey AS user_id, c_nationkey AS team_id FROM {customer}""",
    # recipients answer the invitations they have seen
    "invite_responses": """
SELECT id AS invitation_id, team_id, recipient_id AS user_id,
 CASE WHEN id % 2 = 0 THEN 'accept' ELSE 'decline' END AS response
FROM {team_invitations} WHERE seen""",
    # one sign-up request per customer; every 50th reuses an existing username
    "registrations": """
SELECT c_custkey AS id,
 CASE WHEN c_custkey % 50 = 0 THEN c_name ELSE concat('n', CAST(c_custkey % 400 AS STRING)) END AS username,
 concat('m', CAST((c_custkey * 7) % 900 AS STRING), '@example.org') AS email
FROM {customer}""",
    "activity_changes": """
SELECT event_id AS seq, user_id*10 + event_id % 11 AS id, user_id, concat('v', CAST(event_id AS STRING)) AS name,
 CAST(floor(value) AS INT) AS points,
 CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'I' ELSE 'U' END AS op
FROM {events}""",
    # JSON log requests; every 19th is cut off, every 3rd names an activity id
    # (every 9th a malformed one)
    "requests_json": """
SELECT event_id AS id, CASE WHEN event_id % 19 = 0 THEN '{{"activity_name": 5' ELSE concat('{{"activity_name":"', event_type,
 '","activity_points":', CAST(event_id % 21 - 10 AS STRING), ',"activity_duration":', CAST(CAST(floor(value) AS INT) AS STRING),
 ',"activity_description":"d","one_time":"', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, '"',
 CASE WHEN event_id % 3 = 0 THEN concat(',"activity_id":"', CASE WHEN event_id % 9 = 0 THEN 'x' ELSE '' END,
  CAST(user_id * 10 + event_id % 10 AS STRING), '"') ELSE '' END, '}}') END AS value
FROM {events}""",
    # goal requests: every click sets a goal; some dates carry an offset or a fraction, some are junk
    "goal_requests": """
SELECT event_id AS id, user_id,
 CASE WHEN event_id % 13 = 0 THEN concat('day ', CAST(event_id AS STRING))
  WHEN event_id % 5 = 0 THEN concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '+02:00')
  WHEN event_id % 7 = 0 THEN concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '.123456789-11:30')
  ELSE date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'") END AS goal_date,
 CAST(floor(value) AS INT) % 50 AS goal_points, ts AS requested_at
FROM {events} WHERE event_type = 'click'""",
}

# Views whose DuckDB text cannot come from the rewrite rules (array literals).
DUCKDB_OVERRIDES = {
    "goal_requests": """
SELECT event_id AS id, user_id,
 CASE WHEN event_id % 13 = 0 THEN concat('day ', CAST(event_id AS VARCHAR))
  WHEN event_id % 5 = 0 THEN concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '+02:00')
  WHEN event_id % 7 = 0 THEN concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '.123456789-11:30')
  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS goal_date,
 CAST(floor(value) AS INT) % 50 AS goal_points, ts AS requested_at
FROM {events} WHERE event_type = 'click'""",
    "team_activities": """
SELECT p_partkey AS id, p_partkey % 25 AS team_id, p_name AS activity_name, p_size - 25 AS points,
 DATE '2024-01-01' + CAST(p_partkey % 400 AS INT) AS created_at,
 DATE '2024-01-01' + CAST(p_partkey % 400 + p_size AS INT) AS updated_at,
 CASE p_partkey % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['1-URGENT'] WHEN 2 THEN ['2-HIGH','3-MEDIUM']
  ELSE ['5-LOW','2-HIGH','1-URGENT'] END AS activity_roles
FROM {part}""",
}

# The same rows in a Spark text of their own. Several parts of a query read these two tables, each with its own
# filters; these would be pushed below the DISTINCT and the table built anew for every part. inline() gives new columns,
# which no filter passes, so the parts share one exchange; and it holds keys alone, from which the id follows.
SPARK_OVERRIDES = {
    "team_memberships": """
SELECT inline(array(struct(user_id*100 + team_id AS id, team_id, user_id))) FROM (
 SELECT DISTINCT o.o_custkey AS user_id, s.s_nationkey AS team_id
 FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey JOIN {supplier} s ON s.s_suppkey = l.l_suppkey)""",
    "team_user_roles": """
SELECT inline(array(struct(team_membership_id*10 + role_id % 10 AS id, team_membership_id, role_id))) FROM (
 SELECT DISTINCT tm.id AS team_membership_id, tr.id AS role_id
 FROM {team_memberships} tm JOIN {customer} c ON c.c_custkey = tm.user_id AND c.c_mktsegment <> 'HOUSEHOLD'
 JOIN (SELECT o_custkey, o_orderpriority,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM {orders}) o
  ON o.o_custkey = tm.user_id AND o.rn <= 2
 JOIN {team_roles} tr ON tr.team_id = tm.team_id
  AND (tr.role_name = o.o_orderpriority OR (tr.role_name = 'owner' AND tm.user_id % 25 = tm.team_id)))""",
}

_PLACEHOLDER = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def deps(name: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(VIEWS[name])))


def _rewrite_for_duckdb(text: str) -> str:
    text = text.replace("AS STRING", "AS VARCHAR").replace("TIMESTAMP_NTZ", "TIMESTAMP")
    text = text.replace("explode(sequence(", "unnest(generate_series(")
    return re.sub(r"INTERVAL (\d+) (\w+)", lambda m: f"INTERVAL '{m[1]} {m[2].lower()}'", text)


def duckdb_text(name: str) -> str:
    src = DUCKDB_OVERRIDES.get(name) or _rewrite_for_duckdb(VIEWS[name])
    return src.format(**{d: d for d in deps(name)}).strip()


def closure(names) -> list[str]:
    """Fixture views needed by ``names``, dependencies first."""
    out: list[str] = []

    def visit(n):
        if n in out or n not in VIEWS:
            return
        for d in deps(n):
            visit(d)
        out.append(n)
    for n in names:
        visit(n)
    return out


def with_views(sql: str, *names: str) -> str:
    """Prefix a DuckDB query with the fixture views it reads as CTEs."""
    views = closure(names)
    if not views:
        return sql.strip()
    ctes = ",\n".join(f"{v} AS (\n{duckdb_text(v)}\n)" for v in views)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def _hpath(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    """Existence on any Hadoop file system (local, HDFS, object stores)."""
    p, fs = _hpath(spark, path)
    return bool(fs.exists(p))


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _hpath(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    p, fs = _hpath(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class Fixtures:
    """Lazily built application tables of one data directory.

    ``fx.users``, ``fx['user_activity_logs']`` ... are ordinary DataFrames;
    nothing is materialised until an operator's plan runs.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, app_dir: str | None = None):
        self.spark, self.sf_dir, self.app_dir = spark, sf_dir, app_dir
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            stored = f"{self.app_dir.rstrip('/')}/{name}.parquet" if self.app_dir else None
            if stored and _exists(self.spark, stored):
                reader = self.spark.read
                schema_file = stored + ".schema.json"
                if _exists(self.spark, schema_file):  # known schema: no footer-reading job
                    reader = reader.schema(T.StructType.fromJson(json.loads(_read_text(self.spark, schema_file))))
                df = reader.parquet(stored)
            elif name in BASE_SCHEMAS:
                df = read_table(self.spark, self.sf_dir, name)
            else:
                df = self.spark.sql(SPARK_OVERRIDES.get(name, VIEWS[name]).strip(), **{d: self[d] for d in deps(name)})
            self._cache[name] = df
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in VIEWS and name not in BASE_SCHEMAS):
            raise AttributeError(name)
        return self[name]

    def materialize(self, app_dir: str, names=None) -> "Fixtures":
        """Write the application tables once (as a deployment stores them:
        at least one file per core, so scans split) and return fixtures
        that read them back instead of re-deriving."""
        cores = self.spark.sparkContext.defaultParallelism
        for n in names or list(VIEWS):
            path = f"{app_dir.rstrip('/')}/{n}.parquet"
            self[n].repartition(cores).write.mode("overwrite").parquet(path)
            # the table's schema next to it, as a catalog keeps it
            _write_text(self.spark, path + ".schema.json", json.dumps(self[n].schema.jsonValue()))
        return Fixtures(self.spark, self.sf_dir, app_dir)
