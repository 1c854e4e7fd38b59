"""Teams, roles, members.

Membership-level facts (owner flag, role names) are reduced per membership
first — each membership holds only a handful of roles — and then joined
by key, so no query forms members × activities or members × members.
Small dimension tables (teams, roles) are not hinted: AQE turns those
joins into broadcast hash joins after measuring them at runtime, and keeps
the sort-merge join when they turn out large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import new_id

OWNER = "owner"  # fixed value: the reference's owner role name
#: members of one role set who are listed together: their ids, as packed dictionary entries, take a small part of the
#: 64 KB that Snappy compresses at a time, which has to hold the list once before it can refer to it
MEMBER_BLOCK = 1024


# ids of new rows, by the natural keys that are unique in their tables
def membership_id(team, user):
    return new_id("membership", team, user)


def role_id(team, name):
    return new_id("team_role", team, name)


def assignment_id(membership, role):
    return new_id("assignment", membership, role)


def membership_roles(tur: DataFrame, roles: DataFrame) -> DataFrame:
    """(team_membership_id, role_id, role_name) for every assignment."""
    return tur.join(roles.select(F.col("id").alias("role_id"), "role_name"), "role_id")


def owner_flags(tur: DataFrame, roles: DataFrame) -> DataFrame:
    """team_membership_id → is_owner, for memberships holding any role."""
    return (membership_roles(tur, roles).groupBy("team_membership_id")
            .agg(F.max((F.col("role_name") == OWNER).cast("int")).alias("is_owner")))


def user_teams(memberships: DataFrame, teams: DataFrame, tur: DataFrame, roles: DataFrame) -> DataFrame:
    """Each user's teams with owner flag 0/1.

    The owner flag is reduced per membership before the join, so there is
    no role fan-out to group away afterwards: (team_id, user_id) is a
    unique key of memberships (checked by the integrity audit, M4)."""
    m = memberships.select(F.col("id").alias("team_membership_id"), "team_id", "user_id")
    j = (m.join(teams.select(F.col("id").alias("team_id"), "name"), "team_id")
         .join(owner_flags(tur, roles), "team_membership_id", "left"))
    return j.select("user_id", "team_id", "name", F.coalesce("is_owner", F.lit(0)).cast("int").alias("is_owner"))


def team_info(ids: DataFrame, teams: DataFrame) -> DataFrame:
    """Team rows for a frame of team ids."""
    return teams.join(ids.select(F.col("team_id").alias("id")).distinct(), "id").select(
        "id", "name", "team_industry", "team_size", "is_private", "created_by")


def team_activities_list(ids: DataFrame, acts: DataFrame) -> DataFrame:
    """Activities of the requested teams, role array kept."""
    return acts.join(ids.select("team_id").distinct(), "team_id").select(
        "team_id", "activity_name", "points", "activity_roles")


def team_roles_list(ids: DataFrame, roles: DataFrame, include_owner: bool) -> DataFrame:
    """T4: roles of the requested teams; without 'owner' unless asked."""
    r = roles if include_owner else roles.where(F.col("role_name") != OWNER)
    return r.join(ids.select("team_id").distinct(), "team_id").select("team_id", "id", "role_name")


def is_team_owner(pairs: DataFrame, memberships: DataFrame, tur: DataFrame, roles: DataFrame) -> DataFrame:
    """T5: for (user, team) pairs with a membership: does it hold 'owner'.
    The reference reads one arbitrary role; here any owner role counts."""
    m = memberships.select(F.col("id").alias("team_membership_id"), "team_id", "user_id")
    j = (pairs.select("user_id", "team_id").distinct().join(m, ["user_id", "team_id"])
         .join(owner_flags(tur, roles), "team_membership_id", "left"))
    return j.select("user_id", "team_id", F.coalesce(F.col("is_owner") == 1, F.lit(False)).alias("is_owner"))


def visible_team_activities(pairs: DataFrame, memberships: DataFrame, tur: DataFrame, roles: DataFrame,
                            acts: DataFrame, block: int = MEMBER_BLOCK) -> DataFrame:
    """Activities a member may see: all of them with 'owner', else those
    whose ``activity_roles`` share a role with the member; an empty role
    array means owners only, a member without roles sees none.

    Members of a team who hold the same set of roles see the same
    activities, so visibility is decided once per (team, role set) — a few
    sets per team — against the team's activities, and members are then
    equi-joined on (team_id, role set). No members × activities product
    is formed beyond the rows the answer itself contains, and no
    output-sized de-duplication shuffle is needed.

    The answer grows with members times activities, so its rows come activity
    by activity, each with the same members in the same order: columnar files
    then store an activity's columns once per run and repeat the member ids
    within a compressor's window. Listed member by member, the ids of a
    team's activities recur too far apart to be found. Hence activities are the
    streamed side, and a set of many members is dealt to blocks of about
    ``block``, which tasks share."""
    m = memberships.select(F.col("id").alias("team_membership_id"), "team_id", "user_id")
    member_sets = (pairs.select("user_id", "team_id").distinct().join(m, ["user_id", "team_id"])
                   .join(membership_roles(tur, roles), "team_membership_id")
                   .groupBy("user_id", "team_id", "team_membership_id")
                   .agg(F.array_sort(F.collect_set("role_name")).alias("role_set")))
    sets = member_sets.groupBy("team_id", "role_set").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n_blocks"))
    a = acts.select(F.col("id").alias("activity_id"), "team_id", "activity_name", "points", "created_at", "updated_at",
                    "activity_roles")
    visible = (sets.join(a, "team_id")
               .where(F.array_contains("role_set", OWNER)
                      | F.coalesce(F.arrays_overlap("role_set", "activity_roles"), F.lit(False)))
               .select("team_id", "role_set", "activity_id", "activity_name", "points", "created_at", "updated_at",
                       F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("_block")))
    members = member_sets.join(sets, ["team_id", "role_set"]).select(
        "team_id", "role_set", "user_id", F.pmod(F.xxhash64("user_id", "team_membership_id"), "n_blocks").cast("int").alias("_block"))
    return visible.join(members, ["team_id", "role_set", "_block"]).select(
        "user_id", "team_id", F.col("activity_id").alias("id"), "activity_name", "points", "created_at",
        "updated_at")


def team_members(requests: DataFrame, memberships: DataFrame, users: DataFrame, tur: DataFrame,
                 roles: DataFrame) -> DataFrame:
    """Members of a team other than the caller, with their role names
    joined by ', ' in name order ('' without roles)."""
    names = (membership_roles(tur, roles).groupBy("team_membership_id")
             .agg(F.array_join(F.array_sort(F.collect_list("role_name")), ", ").alias("roles")))
    m = (memberships.select(F.col("id").alias("team_membership_id"), "team_id", "user_id")
         .join(users.select(F.col("id").alias("user_id"), "username"), "user_id")
         .join(names, "team_membership_id", "left"))
    j = requests.select("team_id", "caller_id").join(m, "team_id").where(F.col("user_id") != F.col("caller_id"))
    return j.select("team_id", "caller_id", F.col("team_membership_id").alias("id"), "username",
                    F.coalesce("roles", F.lit("")).alias("roles"))


def unassigned_roles(requests: DataFrame, memberships: DataFrame, tur: DataFrame, roles: DataFrame) -> DataFrame:
    """Roles of the membership's team that the membership does not hold
    (the usable form; for the reference's, which takes the roles of every
    team, see :func:`unassigned_role_classes`)."""
    m = memberships.select(F.col("id").alias("team_membership_id"), "team_id")
    req = requests.select("team_membership_id").distinct().join(m, "team_membership_id")
    cand = req.join(roles.select(F.col("id").alias("role_id"), "role_name", "team_id"), "team_id")
    held = tur.select("team_membership_id", "role_id")
    return (cand.join(held, ["team_membership_id", "role_id"], "left_anti")
            .select("team_membership_id", F.col("role_id").alias("id"), "role_name"))


def unassigned_role_classes(requests: DataFrame, tur: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """T8 over the roles of *every* team, without the product of memberships
    and roles: memberships that hold the same set of roles lack the same
    ones and form a class.

    Returns (members: team_membership_id, class_id; held: class_id, id;
    all_roles: id, role_name). What a membership lacks is ``all_roles`` without
    the ``held`` roles of its class. Each table grows with its inputs. A
    membership without roles is in the empty class, which holds nothing."""
    held = tur.select("team_membership_id", "role_id").distinct()
    sets = held.groupBy("team_membership_id").agg(F.array_sort(F.collect_set("role_id")).alias("_set"))
    req = requests.select("team_membership_id").distinct().join(sets, "team_membership_id", "left")
    members = req.select("team_membership_id", new_id("role_set", F.coalesce(F.array_join("_set", ","), F.lit(""))).alias("class_id"), "_set")
    classes = members.where(F.col("_set").isNotNull()).groupBy("class_id").agg(F.first("_set").alias("_set"))
    return (members.select("team_membership_id", "class_id"), classes.select("class_id", F.explode("_set").alias("id")),
            roles.select("id", "role_name"))


def bootstrap_teams(requests: DataFrame) -> dict[str, DataFrame]:
    """One team request → team, its 'owner' role, the creator's
    membership and the owner assignment. Ids derive from the request id and
    from natural keys (see ``functions.ids``), so replaying a batch writes
    the same rows."""
    r = requests.select("request_id", "name", "team_industry", "team_size", "is_private", "created_by")
    tid = new_id("team", "request_id")
    role, mem = role_id(tid, F.lit(OWNER)), membership_id(tid, F.col("created_by"))
    teams = r.select(tid.alias("id"), "name", "team_industry", "team_size", "is_private", "created_by")
    roles = r.select(role.alias("id"), F.lit(OWNER).alias("role_name"), tid.alias("team_id"))
    mems = r.select(mem.alias("id"), tid.alias("team_id"),
                    F.col("created_by").alias("user_id"))
    tur = r.select(assignment_id(mem, role).alias("id"), mem.alias("team_membership_id"), role.alias("role_id"))
    return {"teams": teams, "team_roles": roles, "team_memberships": mems, "team_user_roles": tur}


def assign_roles(requests: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One assignment row per selected role id of each request; pairs
    that already exist break the unique key and are reported as conflicts
    instead of written. Requests meet the roles held by their membership, a
    handful, and are exploded behind that join: arrays are shuffled, not a
    row per role, and repeats of a role lie in one task by then."""
    held = existing.select("team_membership_id", "role_id").repartition("team_membership_id").groupBy("team_membership_id").agg(F.collect_set("role_id").alias("_held"))
    asked = requests.select("team_membership_id", "selected_roles").join(held, "team_membership_id", "left")

    def taken(role):  # as in a join, NULL equals nothing
        return F.coalesce(F.array_contains("_held", role), F.lit(False))

    new, conflicts = [asked.select("team_membership_id", F.explode(F.filter("selected_roles", keep)).alias("role_id"))
                      .dropDuplicates(["team_membership_id", "role_id"]) for keep in (lambda x: ~taken(x), taken)]
    return new.select(assignment_id("team_membership_id", "role_id").alias("id"), "team_membership_id", "role_id"), conflicts


def add_roles(requests: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append roles; (role_name, team_id) is unique. Inside the batch
    the first request (by request_id) wins; a name already in the team is a
    conflict. The winner per key is a min() aggregate (partial before the
    shuffle), so a much-requested name costs no per-key sort."""
    first = requests.groupBy("team_id", "role_name").agg(F.min("request_id").alias("request_id"))
    known = existing.select("team_id", "role_name")
    new = first.join(known, ["team_id", "role_name"], "left_anti").select(
        role_id("team_id", "role_name").alias("id"), "role_name", "team_id")
    dup = (requests.join(first.withColumnRenamed("request_id", "_first"), ["team_id", "role_name"])
           .where(F.col("request_id") != F.col("_first"))
           .select("request_id", "team_id", "role_name", F.lit("duplicate in batch").alias("reason")))
    clash = first.join(known, ["team_id", "role_name"], "left_semi").select(
        "request_id", "team_id", "role_name", F.lit("role exists").alias("reason"))
    return new, dup.unionByName(clash)


def add_team_activities(requests: DataFrame) -> DataFrame:
    """Append team activities (no unique key on this table)."""
    return requests.select(new_id("team_activity", "request_id").alias("id"), "team_id", "activity_name", "points", "created_at",
                           F.col("created_at").alias("updated_at"), "activity_roles")
