"""M1–M7: table maintenance re-expressed as joins (UPDATE / DELETE / MERGE
are not available on plain parquet tables; each job returns the new state
of the table, to be written atomically by the caller)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import null_split_left_join


def edit_catalog(acts: DataFrame, edits: DataFrame) -> DataFrame:
    """M1: apply the last edit (by seq) per activity id: new name and
    points, type becomes 'custom'. Logged points keep their old values."""
    last = (edits.groupBy("id")
            .agg(F.max_by(F.struct("name", "points"), "seq").alias("_e")))
    j = acts.join(last, "id", "left")
    hit = F.col("_e").isNotNull()
    return j.select("id", "user_id",
                    F.when(hit, F.col("_e.name")).otherwise(F.col("name")).alias("name"),
                    F.when(hit, F.col("_e.points")).otherwise(F.col("points")).alias("points"),
                    F.when(hit, F.lit("custom")).otherwise(F.col("activity_type")).alias("activity_type"))


def delete_activities(acts: DataFrame, logs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M2: delete activities and, by cascade, their logs. Logs with a NULL
    activity (one-time logs) always survive, and skip the join: hashed
    together they would land in one task."""
    gone = ids.select("id").distinct()
    new_acts = acts.join(gone, "id", "left_anti")
    kept = (logs.where(F.col("activity_id").isNotNull())
            .join(gone.withColumnRenamed("id", "activity_id"), "activity_id", "left_anti").select(*logs.columns))
    return new_acts, kept.unionByName(logs.where(F.col("activity_id").isNull()))


# The constraints of the final schema. Per table: unique keys
# (the primary key first), foreign keys (column, parent, what a delete of the
# parent does), and the other columns that may not be NULL.
CASCADE, BLOCK = "cascade", "block"
CONSTRAINTS: dict[str, tuple] = {
    "users": ([("id",), ("email",), ("username",), ("google_id",)], [], ["username", "email"]),
    "user_activities": ([("id",)], [("user_id", "users", BLOCK)], ["name", "points", "activity_type"]),
    "user_activity_logs": ([("id",)], [("user_id", "users", CASCADE), ("activity_id", "user_activities", CASCADE)],
                           ["duration", "points", "activity_description", "logged_at"]),
    "user_goals": ([("id",)], [("user_id", "users", CASCADE)], ["goal_date", "goal_points", "created_at"]),
    "user_streaks": ([("user_id",)], [("user_id", "users", CASCADE)], []),
    "teams": ([("id",)], [("created_by", "users", BLOCK)], ["name", "team_industry", "team_size", "is_private"]),
    "team_memberships": ([("id",), ("team_id", "user_id")], [("team_id", "teams", CASCADE), ("user_id", "users", CASCADE)], []),
    "team_roles": ([("id",), ("role_name", "team_id")], [("team_id", "teams", BLOCK)], ["role_name"]),
    "team_user_roles": ([("id",), ("team_membership_id", "role_id")],
                        [("team_membership_id", "team_memberships", CASCADE), ("role_id", "team_roles", CASCADE)], []),
    "team_activities": ([("id",)], [("team_id", "teams", CASCADE)], ["activity_name", "points", "created_at", "updated_at"]),
    "team_invitations": ([("id",)], [("team_id", "teams", CASCADE), ("sender_id", "users", CASCADE), ("recipient_id", "users", CASCADE)],
                         ["status", "created_at"]),
    "team_activity_logs": ([("id",)], [("team_id", "teams", BLOCK), ("user_id", "users", BLOCK)], ["activity_name", "points", "logged_at"]),
    "team_activity_requests": ([("id",)], [("team_id", "teams", BLOCK), ("user_id", "users", BLOCK)], ["activity_name", "points", "created_at"]),
    "password_reset": ([("token",)], [("user_id", "users", BLOCK)], ["expires_at"]),
    "suggestions": ([("id",)], [], ["title", "description"]),
}
NULLABLE_KEYS = {("users", "google_id"), ("user_activity_logs", "activity_id")}

USER_CASCADES = [(t, c) for t, (_, fks, _) in CONSTRAINTS.items() for c, ref, rule in fks if ref == "users" and rule == CASCADE]
USER_BLOCKERS = [(t, c) for t, (_, fks, _) in CONSTRAINTS.items() for c, ref, rule in fks if ref == "users" and rule == BLOCK]


def cascade_delete_users(tables: dict[str, DataFrame], user_ids: DataFrame) -> dict[str, DataFrame]:
    """M3: delete users with ON DELETE CASCADE semantics. A user still
    referenced through a non-cascading key is blocked (kept, reported in
    ``blocked``); the others go with every row that references them, and
    memberships take their role assignments along."""
    req = user_ids.select(F.col("id").alias("uid")).distinct()
    blockers = [tables[t].select(F.col(c).alias("uid")) for t, c in USER_BLOCKERS if t in tables]
    blocked = req.join(reduce(DataFrame.unionByName, blockers).distinct(), "uid", "left_semi") if blockers \
        else req.limit(0)
    doomed = req.join(blocked, "uid", "left_anti")
    out = dict(tables)
    out["blocked"] = blocked.withColumnRenamed("uid", "id")
    out["users"] = tables["users"].join(doomed.withColumnRenamed("uid", "id"), "id", "left_anti")
    for t, c in USER_CASCADES:
        if t in tables:
            out[t] = out[t].join(doomed.withColumnRenamed("uid", c), c, "left_anti").select(*tables[t].columns)
    if "team_user_roles" in tables and "team_memberships" in tables:
        gone_m = tables["team_memberships"].join(doomed.withColumnRenamed("uid", "user_id"), "user_id", "left_semi")
        out["team_user_roles"] = tables["team_user_roles"].join(
            gone_m.select(F.col("id").alias("team_membership_id")), "team_membership_id", "left_anti")
    return out


def audit_rules(tables: dict[str, list[str]]) -> list[tuple[str, str, str, tuple, str | None]]:
    """(table, rule name, kind, columns, parent) of every constraint whose columns and parent are given; ``tables``:
    table -> columns."""
    rules = []
    for t, (keys, fks, others) in CONSTRAINTS.items():
        have = set(tables.get(t, ()))
        for i, key in enumerate(keys):
            if have.issuperset(key):
                rules.append((t, f"{'unique' if i else 'pk'}({','.join(key)})", "unique", key, None))
        for c, ref, _ in fks:
            if c in have and ref in tables:
                rules.append((t, f"fk({c})", "child", (c,), ref))
        for c in dict.fromkeys([c for key in keys for c in key] + [f[0] for f in fks] + others):
            if c in have and (t, c) not in NULLABLE_KEYS:
                rules.append((t, f"not null({c})", "null", (c,), None))
    return rules


def integrity_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """M4: violations of every unique key, foreign key and not-null rule of
    the schema that the given tables have the columns for.

    Each table is read once: a row gives one entry (group, key, side) per group
    that its table takes part in. A group is a foreign key with its parent's
    key, a unique key, or a NULL rule; a primary key that references look for
    shares the group of the first of them, so its rows count once for both.
    One aggregate per (group, key), with map-side partial counts (so a
    much-referenced parent costs one row a task), then one per group. Rows
    beyond the first of a key, references without a parent, and NULLs are
    violations; NULL keys never clash. Whole numbers stay such in the keys
    (up to two), other columns are joined as text."""
    spark = next(iter(tables.values())).sparkSession
    rules = audit_rules({t: df.columns for t, df in tables.items()})
    # the group of each rule: of a referenced primary key, that of its first reference
    group = {n: next((m for m, r in enumerate(rules) if kind == "unique" and r[4] == t and cols == CONSTRAINTS[t][0][0]), n)
             for n, (t, _, kind, cols, _) in enumerate(rules)}
    whole = {(t, f.name) for t, df in tables.items() for f in df.schema if isinstance(f.dataType, T.IntegralType)}

    def entry(n, held, cols, whole_cols):
        numbers = [F.col(c).cast("bigint") for c, w in zip(cols, whole_cols) if w][:2]
        rest = [c for c, w in zip(cols, whole_cols) if not w] + [c for c, w in zip(cols, whole_cols) if w][2:]
        text = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in rest]) if rest else F.lit(None).cast("string")
        a, b = (numbers + [F.lit(None).cast("bigint")] * 2)[:2]
        given = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in cols])
        return F.when(given, F.struct(F.lit(n).alias("grp"), a.alias("a"), b.alias("b"), text.alias("s"), F.lit(held).alias("held")))

    parts = []
    for t, df in tables.items():
        entries = []
        for n, (table, _, kind, cols, parent) in enumerate(rules):
            alike = [(table, c) in whole for c in cols]
            if kind == "child":  # both sides of a reference as numbers, or both as text
                key = CONSTRAINTS[parent][0][0]
                alike = [(table, cols[0]) in whole and (parent, key[0]) in whole]
                if parent == t:  # serves the parent's own key too, where that rule has this group
                    entries.append(entry(n, True, key, alike))
            if table == t and kind == "null":
                entries.append(F.when(F.col(cols[0]).isNull(), F.struct(
                    F.lit(n).alias("grp"), *[F.lit(None).cast(k).alias(c) for c, k in (("a", "bigint"), ("b", "bigint"), ("s", "string"))], F.lit(False).alias("held"))))
            elif table == t and (kind == "child" or group[n] == n):
                entries.append(entry(n, kind == "unique", cols, alike))
        if entries:
            parts.append(df.select(F.explode(F.array(*entries)).alias("e")).where("e IS NOT NULL").select("e.*"))
    names = spark.createDataFrame([(n, group[n], t, r, kind) for n, (t, r, kind, _, _) in enumerate(rules)],
                                  "rule_id int, grp int, `table` string, rule string, kind string")
    per = (reduce(DataFrame.unionByName, parts).groupBy("grp", "a", "b", "s")
           .agg(F.count(F.when(F.col("held"), 1)).alias("holders"), F.count(F.when(~F.col("held"), 1)).alias("others")))
    counts = per.groupBy("grp").agg(F.sum(F.greatest(F.col("holders") - 1, F.lit(0))).alias("unique"),
                                    F.sum(F.when(F.col("holders") == 0, F.col("others")).otherwise(0)).alias("unheld"))
    found = F.when(F.col("kind") == "unique", F.col("unique")).otherwise(F.col("unheld"))
    return (names.join(counts, "grp", "left")
            .select("table", "rule", F.coalesce(found, F.lit(0)).cast("bigint").alias("violations")))


def rescore_catalog(acts: DataFrame, rates: DataFrame) -> DataFrame:
    """M5: set points from a name → points table; other rows unchanged. A
    name that the rates repeat takes its lowest points: an update never adds rows."""
    r = rates.groupBy("name").agg(F.min("points").alias("_p"))
    return acts.join(r, "name", "left").select(
        "id", "user_id", "name", F.coalesce("_p", "points").alias("points"), "activity_type")


def remap_keys(df: DataFrame, mapping: DataFrame, cols: list[str]) -> DataFrame:
    """M6: UPDATE ... FROM: replace old ids by new ones in ``cols``. An old id
    that the mapping repeats takes its lowest new id; rows with a NULL key
    skip the join."""
    each = mapping.groupBy("old_id").agg(F.min("new_id").alias("new_id"))
    out = df
    for c in cols:
        m = each.select(F.col("old_id").alias(c), F.col("new_id").alias(f"_{c}_new"))
        out = null_split_left_join(out, m, c).withColumn(c, F.coalesce(f"_{c}_new", c)).drop(f"_{c}_new")
    return out.select(*df.columns)


def compact_changes(base: DataFrame, changes: DataFrame, key: str, seq: str, cols: list[str]) -> DataFrame:
    """M7: insert / update / delete change log → current state: the latest
    change per key (base rows count as seq -inf), deletes dropped. Replaying
    the same changes gives the same state."""
    b = base.select(key, *cols, F.lit(None).cast("bigint").alias(seq), F.lit("I").alias("op"))
    c = changes.select(key, *cols, F.col(seq).cast("bigint"), "op")
    allr = b.unionByName(c)
    latest = (allr.groupBy(key)
              .agg(F.max_by(F.struct(*cols, "op"), F.coalesce(F.col(seq), F.lit(-(2 ** 62)))).alias("_r")))
    return latest.where(F.col("_r.op") != "D").select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])
