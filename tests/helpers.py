import datetime as dt

from pyspark.sql import types as T

from habitlake.sources.tables import APP_SCHEMAS

LOGS = APP_SCHEMAS["user_activity_logs"]
ACTS = APP_SCHEMAS["user_activities"]
GOALS = APP_SCHEMAS["user_goals"]
USERS = T.StructType(APP_SCHEMAS["users"].fields[:4])  # without the password


def ts(s):
    return dt.datetime.fromisoformat(s)


def d(s):
    return dt.date.fromisoformat(s)


def df(spark, rows, schema):
    if isinstance(schema, str):
        return spark.createDataFrame(rows, schema)
    return spark.createDataFrame(rows, schema)


def log(i, user, dur, pts, at, act=None, desc="x"):
    return (i, user, act, dur, pts, desc, ts(at))


def rows(df_, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df_.collect())


TEAM_SCHEMAS = {
    "memberships": T.StructType([T.StructField("id", T.LongType()), T.StructField("team_id", T.LongType()),
                                 T.StructField("user_id", T.LongType())]),
    "roles": T.StructType([T.StructField("id", T.LongType()), T.StructField("role_name", T.StringType()),
                           T.StructField("team_id", T.LongType())]),
    "tur": T.StructType([T.StructField("id", T.LongType()), T.StructField("team_membership_id", T.LongType()),
                         T.StructField("role_id", T.LongType())]),
}
