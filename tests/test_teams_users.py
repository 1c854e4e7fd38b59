"""Teams, invitations, users, feedback and maintenance on hand-made rows."""

from pyspark.sql import functions as F

from helpers import TEAM_SCHEMAS, USERS, d, df, rows, ts

from habitlake.operators import feedback as B
from habitlake.operators import invitations as V
from habitlake.operators import maintenance as M
from habitlake.operators import teams as T
from habitlake.operators import users as U

ACT_T = ("id long, team_id long, activity_name string, points int, created_at date, updated_at date, "
         "activity_roles array<string>")


def _team(spark):
    mem = df(spark, [(1, 7, 100), (2, 7, 101), (3, 7, 102), (4, 8, 100)], TEAM_SCHEMAS["memberships"])
    roles = df(spark, [(70, "owner", 7), (71, "A", 7), (72, "B", 7), (80, "owner", 8)], TEAM_SCHEMAS["roles"])
    tur = df(spark, [(1, 1, 70), (2, 2, 71), (3, 2, 72)], TEAM_SCHEMAS["tur"])  # 102 holds no role
    return mem, roles, tur


def test_visible_activities_roles(spark):
    mem, roles, tur = _team(spark)
    acts = df(spark, [(1, 7, "all-empty", 1, d("2024-01-01"), d("2024-02-01"), []),        # owners only
                      (2, 7, "a", 1, d("2024-01-02"), d("2024-02-01"), ["A"]),
                      (3, 7, "ab", 1, d("2024-01-03"), d("2024-02-01"), ["A", "B"])], ACT_T)
    pairs = df(spark, [(100, 7), (101, 7), (102, 7), (999, 7)], "user_id long, team_id long")
    out = rows(T.visible_team_activities(pairs, mem, tur, roles, acts), "user_id", "id")
    # owner sees all three; member with A and B sees 2 and 3 once each; no-role member and stranger see none
    assert out == [(100, 1), (100, 2), (100, 3), (101, 2), (101, 3)]


def test_visible_activities_come_activity_by_activity(spark):
    """Listed member by member, an answer of many members and activities hardly compresses."""
    mem = df(spark, [(u, 7, 100 + u) for u in range(60)], TEAM_SCHEMAS["memberships"])
    roles = df(spark, [(70, "owner", 7), (71, "A", 7)], TEAM_SCHEMAS["roles"])
    tur = df(spark, [(u, u, 71 if u else 70) for u in range(60)], TEAM_SCHEMAS["tur"])
    acts = df(spark, [(i, 7, f"a{i}", 1, d("2024-01-01"), d("2024-02-01"), ["A"] if i % 2 else []) for i in range(40)], ACT_T)
    pairs = df(spark, [(100 + u, 7) for u in range(60)], "user_id long, team_id long")
    want = sorted([(100, i) for i in range(40)] + [(100 + u, i) for u in range(1, 60) for i in range(1, 40, 2)])
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        listed = [r["id"] for r in T.visible_team_activities(pairs, mem, tur, roles, acts).collect()]
        # the owner's 40 activities and the 20 of role A: one run of rows each
        assert sum(a != b for a, b in zip([None, *listed], listed)) <= 60 < len(listed)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    for block in (7, 1024):  # blocks change no row
        assert rows(T.visible_team_activities(pairs, mem, tur, roles, acts, block), "user_id", "id") == want


def test_owner_flags_members_and_unassigned(spark):
    mem, roles, tur = _team(spark)
    pairs = df(spark, [(100, 7), (101, 7), (102, 7), (100, 8)], "user_id long, team_id long")
    assert rows(T.is_team_owner(pairs, mem, tur, roles), "user_id", "team_id", "is_owner") == \
        [(100, 7, True), (100, 8, False), (101, 7, False), (102, 7, False)]
    users = df(spark, [(100, "ann", "a@x", None), (101, "bob", "b@x", None), (102, "cy", "c@x", None)], USERS)
    req = df(spark, [(7, 100)], "team_id long, caller_id long")
    assert rows(T.team_members(req, mem, users, tur, roles), "id", "username", "roles") == \
        [(2, "bob", "A, B"), (3, "cy", "")]
    un = T.unassigned_roles(df(spark, [(2,), (3,)], "team_membership_id long"), mem, tur, roles)
    assert rows(un, "team_membership_id", "role_name") == [(2, "owner"), (3, "A"), (3, "B"), (3, "owner")]


def test_assign_and_add_roles_conflicts(spark):
    mem, roles, tur = _team(spark)
    req = df(spark, [(2, [71, 72, 70]), (3, [71, 71])], "team_membership_id long, selected_roles array<long>")
    new, conf = T.assign_roles(req, tur)
    assert rows(new, "team_membership_id", "role_id") == [(2, 70), (3, 71)]
    assert rows(conf, "team_membership_id", "role_id") == [(2, 71), (2, 72)]
    rr = df(spark, [(1, 7, "C"), (2, 7, "C"), (3, 7, "A")], "request_id long, team_id long, role_name string")
    new, conf = T.add_roles(rr, roles)
    assert rows(new, "team_id", "role_name") == [(7, "C")]
    assert rows(conf, "request_id", "reason") == [(2, "duplicate in batch"), (3, "role exists")]


def test_assign_roles_repeats_and_nulls(spark):
    """Repeated requests give a pair once; NULL equals nothing, so it is no conflict."""
    _, _, tur = _team(spark)
    req = df(spark, [(2, [71, 73, None]), (2, [73, 74, 71]), (None, [71]), (9, []), (9, None)], "team_membership_id long, selected_roles array<long>")
    held = tur.unionByName(df(spark, [(8, 2, None), (9, None, 71)], TEAM_SCHEMAS["tur"]))
    new, conf = T.assign_roles(req, held)
    assert sorted(new.select("team_membership_id", "role_id").collect(), key=str) == sorted([(2, 73), (2, 74), (2, None), (None, 71)], key=lambda r: f"Row(team_membership_id={r[0]}, role_id={r[1]})")
    assert rows(conf, "team_membership_id", "role_id") == [(2, 71)]


def test_search_wildcards_and_repeats(spark):
    users = df(spark, [(1, "a%b", "1@x", None), (2, "axb", "2@x", None), (3, "zzz", "3@x", None)], USERS)
    inv = df(spark, [(10, 5, 0, 2, "pending", ts("2024-01-01 00:00:00"), False),
                     (11, 5, 0, 2, "pending", ts("2024-01-02 00:00:00"), False)],
             "id long, team_id long, sender_id long, recipient_id long, status string, created_at timestamp_ntz, "
             "seen boolean")
    s = df(spark, [(0, "a%b", 5, 99), (1, "_", 5, 3)], "search_id int, q string, team_id long, caller_id long")
    out = rows(U.search_users(s, users, inv, limit=3), "search_id", "rn", "username", "has_been_invited")
    # '%' is a wildcard; the repeated invitation repeats the user and counts toward the limit
    assert out == [(0, 1, "a%b", False), (0, 2, "axb", True), (0, 3, "axb", True),
                   (1, 1, "a%b", False), (1, 2, "axb", True), (1, 3, "axb", True)]
    assert rows(V.unread_counts(inv, users), "recipient_id", "invite_count") == [(1, 0), (2, 2), (3, 0)]


def test_registration_rejects_free_names(spark):
    users = df(spark, [(1, "taken", "t@x", None)], USERS)
    req = df(spark, [(1, "n1", "t@x"), (2, "n2", "e2"), (3, "n2", "e3"), (4, "n4", "e2"), (5, "taken", "e5"),
                     (6, "n6", "e6"), (7, "n6", "e7")], "id long, username string, email string")
    out = rows(U.admit_registrations(users, req), "id", "outcome")
    assert out == [(1, U.EMAIL_TAKEN), (2, "accepted"), (3, U.USERNAME_TAKEN), (4, U.EMAIL_TAKEN),
                   (5, U.USERNAME_TAKEN), (6, "accepted"), (7, U.USERNAME_TAKEN)]
    # request 1 was rejected, so its username n1 stays free for a later one
    req2 = df(spark, [(1, "n1", "t@x"), (2, "n1", "e9")], "id long, username string, email string")
    assert rows(U.admit_registrations(users, req2), "id", "outcome") == [(1, U.EMAIL_TAKEN), (2, "accepted")]


def test_reset_outcomes(spark):
    users = df(spark, [(1, "a", "a@x", None)], USERS)
    resets = df(spark, [(50, 1, ts("2024-01-01 10:00:00"), ts("2024-01-01 10:20:00")),
                        (60, 1, ts("2024-01-01 11:00:00"), ts("2024-01-01 11:20:00"))],
                "token long, user_id long, created_at timestamp_ntz, expires_at timestamp_ntz")
    att = df(spark, [(1, 50, ts("2024-01-01 10:05:00")), (2, 50, ts("2024-01-01 10:06:00")),
                     (3, 60, ts("2024-01-01 12:00:00")), (4, 77, ts("2024-01-01 12:00:00"))],
             "attempt_id long, token long, attempted_at timestamp_ntz")
    assert rows(U.redeem_resets(resets, att, users), "attempt_id", "outcome", "email") == \
        [(1, "valid", "a@x"), (2, "invalid", None), (3, "expired", None), (4, "invalid", None)]


def test_votes_and_ranking(spark):
    s = df(spark, [(1, "t1", "d", 1, 0), (2, "t2", "d", 1, 3)], "id long, title string, description string, "
           "user_id long, upvote int")
    v = df(spark, [(1, 1, 1), (2, 1, 1), (3, 2, -1)], "event_id long, suggestion_id long, delta int")
    t = B.vote_tally(s, v)
    assert rows(t, "id", "upvote") == [(1, 2), (2, 2)]
    top = B.suggestion_ranking(t, s, limit=1).collect()
    assert [(r.pos, r.id) for r in top] == [(1, 1)]


def test_compact_changes_idempotent(spark):
    base = df(spark, [(1, 10, "a", 1), (2, 10, "b", 2)], "id long, user_id long, name string, points int")
    ch = df(spark, [(5, 1, 10, "a2", 3, "U"), (6, 2, 10, "b", 2, "D"), (7, 3, 10, "c", 1, "I"),
                    (8, 3, 10, "c2", 4, "U")], "seq long, id long, user_id long, name string, points int, op string")
    once = M.compact_changes(base, ch, "id", "seq", ["user_id", "name", "points"])
    twice = M.compact_changes(base, ch.unionByName(ch), "id", "seq", ["user_id", "name", "points"])
    assert rows(once, "id", "name", "points") == [(1, "a2", 3), (3, "c2", 4)]
    assert rows(once, "id", "name", "points") == rows(twice, "id", "name", "points")


def test_search_index_matches_plain_ilike(spark):
    """The trigram path must give exactly what ILIKE over all users gives."""
    names = ["Customer#000000001", "customer#0000001x", "abc_def", "ABCxDEF", "zz%zz", "a\\\\bcd", "xyz"]
    users = df(spark, [(i, n, f"{i}@x", None) for i, n in enumerate(names)], USERS)
    inv = df(spark, [], "id long, team_id long, sender_id long, recipient_id long, status string, "
             "created_at timestamp_ntz, seen boolean")
    qs = ["00001", "CUSTOMER", "abc_def", "bc%de", "b\\\\_d", "%", "yz", "mer#0000", "", "_", "A", "b%e", "\\_", "__%__", "é", "K"]
    s = df(spark, [(i, q, 1, -1) for i, q in enumerate(qs)], "search_id int, q string, team_id long, caller_id long")
    got = rows(U.search_users(s, users, inv, limit=100), "search_id", "id")
    want = rows(s.join(users, F.expr("username ILIKE concat('%', q, '%')")), "search_id", "id")
    assert got == want


def test_accept_when_already_member_still_removes_invitation(spark):
    inv = df(spark, [(1, 7, 0, 100, "pending", ts("2024-01-01 00:00:00"), False),
                     (2, 7, 0, 101, "pending", ts("2024-01-01 00:00:00"), False),
                     (3, 8, 0, 101, "pending", ts("2024-01-01 00:00:00"), False)],
             "id long, team_id long, sender_id long, recipient_id long, status string, created_at timestamp_ntz, "
             "seen boolean")
    mem = df(spark, [(1, 7, 100)], TEAM_SCHEMAS["memberships"])
    resp = df(spark, [(1, 7, 100, "accept"), (2, 7, 101, "decline")],
              "invitation_id long, team_id long, user_id long, response string")
    remaining, members = V.apply_responses(inv, mem, resp)
    assert rows(remaining, "id") == [(3,)]
    assert rows(members, "team_id", "user_id") == [(7, 100)]  # no duplicate membership
    seen = V.mark_seen(inv, df(spark, [(101,)], "user_id long"))
    assert rows(seen, "id", "seen") == [(1, False), (2, True), (3, True)]


def test_cascade_delete_blocked_by_team_owner(spark):
    users = df(spark, [(1, "a", "a@x", None), (2, "b", "b@x", None)], USERS)
    teams = df(spark, [(7, "t", "i", 5, False, 1)], "id long, name string, team_industry string, team_size int, "
               "is_private boolean, created_by long")
    goals = df(spark, [(1, 1, d("2024-01-01"), 5, ts("2024-01-01 06:00:00"), "x"),
                       (2, 2, d("2024-01-01"), 5, ts("2024-01-01 06:00:00"), "x")],
               "id long, user_id long, goal_date date, goal_points int, created_at timestamp_ntz, status string")
    out = M.cascade_delete_users({"users": users, "teams": teams, "user_goals": goals},
                                 df(spark, [(1,), (2,)], "id long"))
    assert rows(out["blocked"], "id") == [(1,)]       # user 1 created a team (no ON DELETE)
    assert rows(out["users"], "id") == [(1,)]
    assert rows(out["user_goals"], "id") == [(1,)]    # user 2's goal went with the user


def test_catalog_owner_is_blocked(spark):
    users = df(spark, [(1, "a", "a@x", None), (2, "b", "b@x", None)], USERS)
    acts = df(spark, [(5, 2, "Run", 10, "custom")], "id long, user_id long, name string, points int, activity_type string")
    out = M.cascade_delete_users({"users": users, "user_activities": acts}, df(spark, [(1,), (2,)], "id long"))
    assert rows(out["blocked"], "id") == [(2,)]
    assert rows(out["users"], "id") == [(2,)]
    assert out["user_activities"].count() == 1


def test_updates_never_add_rows(spark):
    acts = df(spark, [(5, 2, "Run", 10, "custom")], "id long, user_id long, name string, points int, activity_type string")
    rates = df(spark, [("Run", 30), ("Run", 20)], "name string, points int")
    assert rows(M.rescore_catalog(acts, rates), "id", "points") == [(5, 20)]
    keyed = df(spark, [(1, 7), (2, None)], "id long, k long")
    mapping = df(spark, [(7, 9), (7, 8)], "old_id long, new_id long")
    assert sorted(map(tuple, M.remap_keys(keyed, mapping, ["k"]).collect())) == [(1, 8), (2, None)]


def test_admission_with_null_email_and_long_chain(spark):
    users = df(spark, [], USERS)
    # each request shares a key with the one before it
    chain = [(i, f"e{i // 2}", f"u{(i + 1) // 2}") for i in range(8)] + [(100, None, "n"), (101, None, "m"), (102, None, "n")]
    got = dict(rows(U.admit_registrations(users, df(spark, chain, "id long, email string, username string")), "id", "outcome"))
    assert [got[i] for i in (100, 101)] == ["accepted"] * 2 and got[102] == U.USERNAME_TAKEN
    emails, names = set(), set()
    for i, e, u in chain[:8]:
        want = U.EMAIL_TAKEN if e in emails else U.USERNAME_TAKEN if u in names else "accepted"
        if want == "accepted":
            emails.add(e)
            names.add(u)
        assert got[i] == want


def test_short_searches_cut_postings_and_keep_order(spark):
    """One and two characters: the first rows by username, the caller left out, repeats counted, no nested loop."""
    import random
    rnd = random.Random(1)
    users = df(spark, [(i, "".join(rnd.choice("abC_") for _ in range(rnd.randrange(5))) + rnd.choice(["", "x", "\u212a"]), f"{i}@x", None) for i in range(400)], USERS)
    inv = df(spark, [(i, 5, 0, rnd.randrange(400), "pending", ts("2024-01-01 00:00:00"), False) for i in range(300)],
             "id long, team_id long, sender_id long, recipient_id long, status string, created_at timestamp_ntz, seen boolean")
    qs = ["a", "C", "ab", "", "%", "_", "a_", "k", "\\_", "zz", "a%b"]
    s = df(spark, [(i, q, 5, c) for i, (q, c) in enumerate([(q, c) for q in qs for c in (-1, 0, 7)])], "search_id int, q string, team_id long, caller_id long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = U.search_users(s, users, inv, limit=4)
        assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
        got = rows(out, "search_id", "rn", "id", "has_been_invited")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    all_pairs = s.join(users, F.expr("username ILIKE concat('%', q, '%') AND id <> caller_id")).join(
        inv.selectExpr("recipient_id AS id", "id AS inv", "team_id"), ["id", "team_id"], "left").collect()
    want = []
    for i in range(len(qs) * 3):
        mine = sorted((r for r in all_pairs if r.search_id == i), key=lambda r: (r.username.encode(), r.id, r.inv is not None, r.inv or 0))[:4]
        want += [(i, k + 1, r.id, r.inv is not None) for k, r in enumerate(mine)]
    assert got == sorted(want)


def test_sign_up_rounds_carry_undecided_requests_only(spark):
    """A chain in which each round settles two requests: later rounds store fewer rows."""
    import glob
    from habitlake.session import ensure_checkpoint_dir
    users = df(spark, [(0, "u", "e", None)], USERS)
    n = 12  # request i shares its email with i - 1 and its username with i + 1, by turns
    req = df(spark, [(i, f"n{(i + 1) // 2}", f"m{i // 2}") for i in range(1, n + 1)], "id long, username string, email string")
    before = set(glob.glob(ensure_checkpoint_dir(spark).replace("file:", "") + "/registrations-*"))
    got = rows(U.admit_registrations(users, req), "id", "outcome")
    taken_u, taken_e, want = set(), set(), []
    for i in range(1, n + 1):
        u, e = f"n{(i + 1) // 2}", f"m{i // 2}"
        out = U.EMAIL_TAKEN if e in taken_e else U.USERNAME_TAKEN if u in taken_u else "accepted"
        if out == "accepted":
            taken_u.add(u)
            taken_e.add(e)
        want.append((i, out))
    assert got == want
    [table] = set(glob.glob(ensure_checkpoint_dir(spark).replace("file:", "") + "/registrations-*")) - before
    sizes = [spark.read.parquet(p).count() for p in sorted(glob.glob(table + "/round=*"), key=lambda p: int(p.rsplit("=", 1)[1]))]
    assert sizes[0] == n and all(a > b for a, b in zip(sizes[1:], sizes[2:]))


def test_role_classes_complement(spark):
    mem, roles, tur = _team(spark)
    req = mem.selectExpr("id AS team_membership_id")
    members, held, every = T.unassigned_role_classes(req, tur, roles)
    h = {}
    for r in held.collect():
        h.setdefault(r.class_id, set()).add(r.id)
    names = {r.id for r in every.collect()}
    mine = {}
    for r in tur.collect():
        mine.setdefault(r.team_membership_id, set()).add(r.role_id)
    got = {r.team_membership_id: names - h.get(r.class_id, set()) for r in members.collect()}
    assert got == {r.id: names - mine.get(r.id, set()) for r in mem.collect()}


def test_account_with_password_and_google_id(spark):
    users = df(spark, [(1, "a", "a@x", None, "h"), (2, "b", "b@x", "g", "h"), (3, "c", "c@x", "g3", None)],
               "id long, username string, email string, google_id string, password_hash string")
    assert rows(U.account_kind(users), "id", "has_password") == [(1, True), (2, True), (3, False)]
    assert [r.google_id for r in U.account_kind(users).orderBy("id").collect()] == [None, None, "g3"]


def test_audit_counts_every_rule_in_one_scan_per_table(spark):
    users = df(spark, [(1, "a", "a@x", None), (1, "b", None, "g"), (2, None, "a@x", "g"), (None, "c", "c@x", "g")], USERS)
    teams = df(spark, [(7, "t", "i", 5, False, 1), (8, None, "i", 5, None, 99), (8, "u", "i", None, True, None)], "id long, name string, "
               "team_industry string, team_size int, is_private boolean, created_by long")
    mem = df(spark, [(1, 7, 1), (2, 7, 1), (3, 7, None), (4, 9, 3)], TEAM_SCHEMAS["memberships"])
    out = {(r.table, r.rule): r.violations for r in M.integrity_audit({"users": users, "teams": teams, "team_memberships": mem}).collect()}
    assert {k: v for k, v in out.items() if v} == {
        ("users", "pk(id)"): 1, ("users", "unique(email)"): 1, ("users", "unique(google_id)"): 2, ("users", "not null(id)"): 1,
        ("users", "not null(email)"): 1, ("users", "not null(username)"): 1, ("teams", "pk(id)"): 1, ("teams", "fk(created_by)"): 1,
        ("teams", "not null(created_by)"): 1, ("teams", "not null(name)"): 1, ("teams", "not null(team_size)"): 1, ("teams", "not null(is_private)"): 1,
        ("team_memberships", "unique(team_id,user_id)"): 1, ("team_memberships", "fk(team_id)"): 1, ("team_memberships", "fk(user_id)"): 1,
        ("team_memberships", "not null(user_id)"): 1}
    assert out["users", "unique(username)"] == 0 and ("team_roles", "pk(id)") not in out
    plan = M.integrity_audit({"users": users, "teams": teams, "team_memberships": mem})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 5  # three tables, the rules twice


def test_audit_groups_keys_once_whatever_their_types(spark):
    """A parent's key shares the group of its first reference, with no lambda per row; whole numbers of any width meet, and
    where one side of a reference is text both are compared as text."""
    users = df(spark, [(i, f"u{n}", f"{n}@x", None) for n, i in enumerate((1, 2, 2, 3))], USERS)
    mem = df(spark, [(1, 7, 1), (2, 7, 9), (2, 8, 9), (4, 8, None)], "id int, team_id int, user_id int")
    goals = df(spark, [(1, "2"), (2, "03"), (3, "9")], "id long, user_id string")
    audit = M.integrity_audit({"users": users, "team_memberships": mem, "user_goals": goals})
    assert {(r.table, r.rule): r.violations for r in audit.collect() if r.violations} == {
        ("users", "pk(id)"): 1, ("team_memberships", "pk(id)"): 1, ("team_memberships", "fk(user_id)"): 2, ("team_memberships", "not null(user_id)"): 1,
        ("user_goals", "fk(user_id)"): 2}
    plan = audit._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
    # the keys of all rules are grouped once, and not joined to the rules before they are counted
    assert [x.split("Aggregate [")[1].split("#")[0] for x in plan.splitlines() if "Aggregate [" in x] == ["grp", "grp"] and plan.count("Join") == 1


def test_stored_tables_have_the_fixed_schemas(spark, fx, tmp_path):
    from habitlake.sources.tables import APP_SCHEMAS, read_app_table
    for name, schema in APP_SCHEMAS.items():
        if name == "user_streaks":
            continue
        wide = lambda t: t.simpleString().replace("int", "bigint").replace("bigbig", "big")  # noqa: E731  (small fixture keys are ints)
        assert [(f.name, wide(f.dataType)) for f in fx[name].schema] == [(f.name, wide(f.dataType)) for f in schema], name
    fx.teams.write.parquet(str(tmp_path / "teams.parquet"))
    assert read_app_table(spark, str(tmp_path), "teams").count() == fx.teams.count()


def test_user_search_broadcasts_neither_users_nor_their_grams(spark):
    """Whatever small size the user table seems to have, only searches and lists cut per gram may pass through the driver."""
    from pyspark.sql import functions as F
    from habitlake.operators import users as U
    users = spark.range(300).select("id", F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("username"))
    searches = spark.createDataFrame([(0, "CUSTOMER", 1, 0), (1, "_4%2", 1, 0), (2, "00001", 1, 0), (3, "99", 1, 99)], "search_id int, q string, team_id int, caller_id int")
    inv = spark.createDataFrame([(7, 142, 1)], "id long, recipient_id long, team_id long")
    out = U.search_users(searches, users, inv)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=merge)") + plan.count("leftHint=(strategy=merge)") == 4
    got = {(r.search_id, r.id, r.has_been_invited) for r in out.collect()}
    assert {x for x in got if x[0] == 1} == {(1, i, i == 142) for i in (42, 142, 242)}
    assert {x[1] for x in got if x[0] == 3} == {199, 299} and len([x for x in got if x[0] == 0]) == 10
