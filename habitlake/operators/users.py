"""Users and accounts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import SEARCH_LIMIT


GRAM = 3      # literal runs of this length and more are looked up by their rarest trigram
POST_SALTS = 16  # parts of a posting list of a shorter gram, which may hold most users


def _grams(low, n: int):
    """Distinct substrings of ``n`` characters of a column."""
    idx = F.sequence(F.lit(1), F.greatest(F.length(low) - (n - 1), F.lit(1)))
    return F.array_distinct(F.filter(F.transform(idx, lambda i: F.substring(low, i, n)), lambda g: F.length(g) == n))


def search_users(searches: DataFrame, users: DataFrame, invitations: DataFrame,
                 limit: int = SEARCH_LIMIT) -> DataFrame:
    """Per search, users whose username ILIKE '%q%' (q unescaped, so
    '%' and '_' act as wildcards), not the caller, flagged when already
    invited to the search's team, by username, first ``limit`` rows.

    Candidates come from an index of username grams, and ILIKE decides
    exactly. A username matches only if it contains each literal run of q
    (q split at wildcards and escaped characters), so a search looks up its
    longest run: the rarest trigram of it, or the run itself when it is
    shorter; a pattern without a run looks up the empty gram, which every
    username has. All look-ups are equi-joins. Users, their grams and the
    gram counts grow with the table, and file sizes tell little of their rows,
    so these joins are sort-merge joins by hint: none is broadcast.

    * A search that is nothing but a run of at most two characters takes the
      first ``limit`` + 1 users of that gram (one may be the caller): posting
      lists are cut there before the join, by a WindowGroupLimit.
    * Other short runs need the whole list: it is dealt over ``POST_SALTS``
      parts, as one gram may hold most users.

    An invitation repeated to the same team repeats the user, and the limit
    counts repeats, as in the reference."""
    s = searches.select("search_id", "q", "team_id", "caller_id")
    u = users.select("id", "username").repartition("id")  # a small file holds many users
    low = F.lower("username")
    runs = F.split(F.lower("q"), r"\\.|[%_]")
    longest = F.aggregate(runs, F.lit(""), lambda acc, x: F.when(F.length(x) > F.length(acc), x).otherwise(acc))
    s = s.withColumn("_run", F.coalesce(longest, F.lit("")))
    plain = (F.col("_run") == F.lower("q")) & ~F.col("q").contains("\\")
    is_long = F.length("_run") >= GRAM
    cols = ["search_id", "q", "team_id", "caller_id"]

    index = u.select("id", F.explode(_grams(low, GRAM)).alias("_g"))
    df_g = index.groupBy("_g").agg(F.count(F.lit(1)).alias("_df"))  # posting-list length per trigram
    long_runs = s.where(is_long)
    probe = (long_runs.select("search_id", F.explode(_grams(F.col("_run"), GRAM)).alias("_g"))
             .join(df_g.hint("merge"), "_g", "left")
             .groupBy("search_id").agg(F.min_by("_g", F.coalesce("_df", F.lit(0))).alias("_g")))
    found = long_runs.join(probe, "search_id").join(index.hint("merge"), "_g").join(u.hint("merge"), "id").select(*cols, "id", "username")

    # postings of the shorter grams that searches ask for
    short = s.where(~is_long).select(*cols, F.col("_run").alias("_g"), plain.alias("_plain"))
    grams = F.concat(F.array(F.lit("")), _grams(low, 1), _grams(low, 2))
    posts = u.select("id", "username", F.explode(grams).alias("_g"))
    first = Window.partitionBy("_g").orderBy("username", "id")
    cut = (posts.join(short.where("_plain").select("_g").distinct(), "_g", "left_semi")
           .withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= limit + 1))
    found_cut = short.where("_plain").join(cut, "_g").select(*cols, "id", "username")
    rest = short.where(~F.col("_plain")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(POST_SALTS - 1))))
    dealt = posts.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(POST_SALTS)).cast("int"))
    found_rest = rest.join(dealt.hint("merge"), ["_g", "_salt"]).select(*cols, "id", "username")

    like = F.expr("username ILIKE concat('%', q, '%')") & (F.col("id") != F.col("caller_id"))
    hits = found.unionByName(found_cut).unionByName(found_rest).where(like)
    inv = invitations.select(F.col("recipient_id").alias("id"), F.col("team_id").alias("_t"),
                             F.col("id").alias("_inv"))
    j = hits.join(inv, (hits.id == inv.id) & (hits.team_id == inv._t), "left").drop(inv.id)
    w = Window.partitionBy("search_id").orderBy("username", "id", "_inv")
    return (j.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)
            .select("search_id", "rn", "id", "username", F.col("_inv").isNotNull().alias("has_been_invited")))


def resolve_users(keys: DataFrame, users: DataFrame) -> DataFrame:
    """Enrich (kind, key) records with the user found by email,
    google_id or username: one equi-join per kind, unioned."""
    cols = ["id", "username", "email", "google_id"]
    parts = []
    for kind in ("email", "google_id", "username"):
        k = keys.where(F.col("kind") == kind).select("kind", "key")
        parts.append(k.join(users.select(*cols), F.col("key") == F.col(kind)).select("kind", "key", *cols))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def redeem_resets(resets: DataFrame, attempts: DataFrame, users: DataFrame) -> DataFrame:
    """U4: each reset attempt → 'valid' (token known, attempt at or before
    expiry, token not yet used), 'expired', or 'invalid' (unknown token or
    already used: a valid use deletes the token).

    Per token only the first in-time attempt can be valid; a
    ``min(struct)`` per token finds it with a partial aggregate."""
    r = resets.join(users.select(F.col("id").alias("user_id"), "email"), "user_id").select(
        "token", "expires_at", "email")
    j = attempts.join(r, "token", "left")
    in_time = F.col("attempted_at") <= F.col("expires_at")
    first = (j.where(F.col("expires_at").isNotNull() & in_time).groupBy("token")
             .agg(F.min(F.struct("attempted_at", "attempt_id")).alias("_first")))
    j2 = j.join(first, "token", "left")
    me = F.struct("attempted_at", "attempt_id")
    outcome = (F.when(F.col("expires_at").isNull(), F.lit("invalid"))
               .when(F.col("_first").isNotNull() & (me > F.col("_first")), F.lit("invalid"))
               .when(~in_time, F.lit("expired"))
               .otherwise(F.lit("valid")))
    return j2.select("attempt_id", "token", outcome.alias("outcome"),
                     F.when(outcome == "valid", F.col("email")).alias("email"))


def account_kind(users: DataFrame) -> DataFrame:
    """An account with a password shows no google_id, also when it has
    one; an account without shows it."""
    has_pw = F.col("password_hash").isNotNull()
    return users.select("id", "username", "email", has_pw.alias("has_password"),
                        F.when(~has_pw, F.col("google_id")).alias("google_id"))


EMAIL_TAKEN = "Email already exists"        # fixed values: the reference's
USERNAME_TAKEN = "Username already exists"  # registration error messages


def admit_registrations(users: DataFrame, requests: DataFrame) -> DataFrame:
    """Decide sign-up requests in request-id order: reject when the
    email (tested first) or the username is held by an existing user or by
    an earlier *accepted* request; a rejected request claims nothing.

    Sequential in the reference; here rounds of a parallel fixpoint: a
    request that is the earliest undecided one in both its email group and
    its username group is accepted (its sequential outcome cannot change),
    and undecided requests sharing a key with one accepted in the round
    are rejected. Each round decides at least the earliest undecided
    request, so the rounds end, and usually far more. A NULL email or
    username equals no other.

    A round reads and writes the undecided requests only; decided ones stay
    in the round's part of a table in the shared checkpoint folder, which
    is the result in the end. That also cuts lineage each round."""
    spark = requests.sparkSession
    from ..session import ensure_checkpoint_dir
    table = f"{ensure_checkpoint_dir(spark)}/registrations-{uuid.uuid4().hex}"
    taken_e = users.select(F.col("email").alias("_e")).distinct().withColumn("_te", F.lit(True))
    taken_u = users.select(F.col("username").alias("_u")).distinct().withColumn("_tu", F.lit(True))
    r = requests.select("id", "email", "username")
    rows = (r.join(taken_e, r.email == taken_e._e, "left").join(taken_u, r.username == taken_u._u, "left")
            .select("id", "email", "username",
                    F.when(F.col("_te"), F.lit(EMAIL_TAKEN)).when(F.col("_tu"), F.lit(USERNAME_TAKEN)).alias("outcome")))
    schema, n = T.StructType([*rows.schema.fields, T.StructField("decided", T.BooleanType())]), 0
    while True:
        part = f"{table}/round={n}"
        rows.withColumn("decided", F.col("outcome").isNotNull()).write.partitionBy("decided").parquet(part)
        und = spark.read.schema(schema).parquet(part).where(~F.col("decided")).drop("outcome", "decided")
        if und.isEmpty():
            return spark.read.schema(T.StructType([*schema.fields, T.StructField("round", T.IntegerType())])).parquet(table).where("decided").select("id", "outcome")
        me = und.groupBy("email").agg(F.min("id").alias("_me"))
        mu = und.groupBy("username").agg(F.min("id").alias("_mu"))
        acc = (und.join(me, "email", "left").join(mu, "username", "left")  # a NULL key clashes with nothing
               .where((F.col("id") == F.coalesce("_me", "id")) & (F.col("id") == F.coalesce("_mu", "id"))))
        acc_id = acc.select("id", F.lit(True).alias("_a"))
        acc_e = acc.select(F.col("email").alias("_ae")).distinct().withColumn("_he", F.lit(True))
        acc_u = acc.select(F.col("username").alias("_au")).distinct().withColumn("_hu", F.lit(True))
        j = (und.join(acc_id, "id", "left").join(acc_e, und.email == acc_e._ae, "left")
             .join(acc_u, und.username == acc_u._au, "left"))
        outcome = (F.when(F.col("_a"), F.lit("accepted"))
                   .when(F.col("_he"), F.lit(EMAIL_TAKEN))
                   .when(F.col("_hu"), F.lit(USERNAME_TAKEN)))
        rows, n = j.select("id", "email", "username", outcome.alias("outcome")), n + 1
