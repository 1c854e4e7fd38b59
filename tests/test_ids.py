"""repeated_ids: counts on hand-made rows, and what its plan shuffles."""

import re

from helpers import TEAM_SCHEMAS, df, rows

from habitlake.operators import teams as T
from habitlake.plans import registry
from habitlake.plans.q_ids import repeated_ids
from habitlake.sources.fixtures import Fixtures
from conftest import SF_SMALL

HEX = "0123456789abcdef0123456789abcdef"


def test_ids_are_equal_only_as_texts(spark):
    text = [HEX, HEX, HEX.upper(), HEX + "\n", "0" * 32, "0" * 16, "0123456789abcdef", bytes.fromhex("41" * 16).decode(), "41" * 16, "7", "", None, None]
    a = df(spark, [(x,) for x in text], "id string")
    b = df(spark, [(7,), (8,), (8,), (None,)], "id long")
    out = rows(repeated_ids({"a": [a, b], "b": [b], "c": [a.limit(1)]}), "table_name", "n_rows", "repeated_ids")
    # a: HEX, 7, 8 and NULL; b: 8
    assert out == [("a", 17, 4), ("b", 4, 1), ("c", 1, 0)]


def _ran(spark, q):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        q.collect()
        return q._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_memberships_and_assignments_are_built_once(spark):
    """Four parts of the query read the memberships and two the assignments, each with filters of its own."""
    p = _ran(spark, registry.REGISTRY["repeated_ids"].build(Fixtures(spark, SF_SMALL)))
    assert len(re.findall(r"SortMergeJoin(?:\(skew=true\))? \[o_orderkey", p)) == 1
    assert len(re.findall(r"SortMergeJoin(?:\(skew=true\))? \[user_id#\d+L\], \[o_custkey", p)) == 1


def test_ids_travel_as_bytes(spark):
    p = _ran(spark, repeated_ids({"a": [df(spark, [(HEX,)], "id string")]}))
    assert re.search(r"Exchange hashpartitioning\(kind#\d+, id#\d+,", p)


def test_roles_to_assign_are_not_shuffled_one_by_one(spark):
    req = df(spark, [(2, [71, 72])], "team_membership_id long, selected_roles array<long>")
    p = _ran(spark, T.assign_roles(req, df(spark, [(1, 2, 71)], TEAM_SCHEMAS["tur"]))[0])
    assert set(re.findall(r"Exchange hashpartitioning\(([^#]*)#\d+L?, (\w+)", p)) == {("team_membership_id", "8")}
