"""S1 — table scans with fixed schemas.

Every table is read with an explicit ``StructType`` (never inferred), so a
schema drift in the files fails fast instead of silently changing types.
Parquet keeps filter pushdown and column pruning; a relational store would
be read with ``spark.read.jdbc(..., column=..., lowerBound=..., upperBound=...,
numPartitions=...)`` so the scan is split across executors.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_L, _I, _S, _D, _TS, _B = (T.LongType(), T.IntegerType(), T.StringType(),
                           T.DoubleType(), T.TimestampNTZType(), T.BooleanType())


def _schema(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


# Source tables the fixture views derive the application tables from.
BASE_SCHEMAS: dict[str, T.StructType] = {
    "region": _schema(("r_regionkey", _I), ("r_name", _S)),
    "nation": _schema(("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I)),
    "customer": _schema(("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I),
                        ("c_acctbal", _D), ("c_mktsegment", _S)),
    "supplier": _schema(("s_suppkey", _L), ("s_name", _S), ("s_nationkey", _I),
                        ("s_acctbal", _D)),
    "part": _schema(("p_partkey", _L), ("p_name", _S), ("p_brand", _S), ("p_type", _S),
                    ("p_size", _I), ("p_retailprice", _D)),
    "orders": _schema(("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S),
                      ("o_totalprice", _D), ("o_orderdate", _TS), ("o_orderpriority", _S)),
    "lineitem": _schema(("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L),
                        ("l_linenumber", _I), ("l_quantity", _D), ("l_extendedprice", _D),
                        ("l_discount", _D), ("l_tax", _D), ("l_returnflag", _S),
                        ("l_linestatus", _S), ("l_shipdate", _TS)),
    "events": _schema(("event_id", _L), ("ts", _TS), ("user_id", _L), ("event_type", _S),
                      ("value", _D), ("props", _S)),
}

# Application tables (final state of the reference schema, ids as BIGINT).
APP_SCHEMAS: dict[str, T.StructType] = {
    "users": _schema(("id", _L), ("username", _S), ("email", _S), ("google_id", _S), ("password_hash", _S)),
    "user_activities": _schema(("id", _L), ("user_id", _L), ("name", _S), ("points", _I),
                               ("activity_type", _S)),
    "user_activity_logs": _schema(("id", _L), ("user_id", _L), ("activity_id", _L),
                                  ("duration", _I), ("points", _I),
                                  ("activity_description", _S), ("logged_at", _TS)),
    "user_goals": _schema(("id", _L), ("user_id", _L), ("goal_date", T.DateType()),
                          ("goal_points", _I), ("created_at", _TS), ("status", _S)),
    "user_streaks": _schema(("user_id", _L), ("current_streak", _I), ("longest_streak", _I),
                            ("last_logged_date", T.DateType())),
    "teams": _schema(("id", _L), ("name", _S), ("team_industry", _S), ("team_size", _I), ("is_private", _B), ("created_by", _L)),
    "team_memberships": _schema(("id", _L), ("team_id", _L), ("user_id", _L)),
    "team_roles": _schema(("id", _L), ("role_name", _S), ("team_id", _L)),
    "team_user_roles": _schema(("id", _L), ("team_membership_id", _L), ("role_id", _L)),
    "team_activities": _schema(("id", _L), ("team_id", _L), ("activity_name", _S), ("points", _I), ("created_at", T.DateType()),
                               ("updated_at", T.DateType()), ("activity_roles", T.ArrayType(_S))),
    "team_invitations": _schema(("id", _L), ("team_id", _L), ("sender_id", _L), ("recipient_id", _L), ("status", _S),
                                ("created_at", _TS), ("seen", _B)),
    "team_activity_logs": _schema(("id", _L), ("team_id", _L), ("user_id", _L), ("activity_name", _S), ("points", _I), ("logged_at", _TS)),
    "team_activity_requests": _schema(("id", _L), ("team_id", _L), ("user_id", _L), ("activity_name", _S), ("points", _I), ("created_at", _TS)),
    "suggestions": _schema(("id", _L), ("title", _S), ("description", _S), ("user_id", _L), ("upvote", _I)),
    "password_reset": _schema(("token", _L), ("user_id", _L), ("created_at", _TS), ("expires_at", _TS)),
}


def read_app_table(spark: SparkSession, app_dir: str, name: str) -> DataFrame:
    """A stored application table with its fixed schema."""
    return spark.read.schema(APP_SCHEMAS[name]).parquet(os.path.join(app_dir, f"{name}.parquet"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = os.path.join(sf_dir, f"{name}.parquet")
    return spark.read.schema(BASE_SCHEMAS[name]).parquet(path)


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All source tables of ``sf_dir`` as lazily-planned DataFrames."""
    return {n: read_table(spark, sf_dir, n) for n in BASE_SCHEMAS}
