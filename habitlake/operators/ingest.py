"""Scoring and ingestion of activity logs.

The reference handles one request at a time and asks an external chat
model twice per text. Here a batch of requests is one DataFrame: regex
extraction runs as JVM expressions per row, matching is an equi-join on
user_id with a residual test, and the daily minutes cap is one count per
user-day along sorted rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import DAILY_MINUTES_CAP, score_points
from ..functions.ids import new_id
from ..sources.fixtures import DEFAULT_CATALOG

# Fixed value: the extraction pattern the reference applies to the model's
# answer (RE2 syntax, where \w, \s and \d are ASCII-only).
REFERENCE_PATTERN = r"Activity\d*:\s*(?P<activity>[\w\s]+),\s*Duration\d*:\s*(?P<duration>\d+)"

_RE2_CLASSES = {  # RE2 class -> the same set spelled out for Java regex
    r"[\w\s]": r"[0-9A-Za-z_\t\n\f\r ]",
    r"\s": r"[\t\n\f\r ]",  # Java's \s would also match \x0B
    r"\d": r"[0-9]",
}


def _jvm_pattern(p: str) -> str:
    """The same pattern for Java regex: RE2's ASCII classes spelled out and
    named groups made plain (they are addressed by index)."""
    for k, v in _RE2_CLASSES.items():
        p = p.replace(k, v)
    return re.sub(r"\(\?P<\w+>", "(", p)


EXTRACT_PATTERN = _jvm_pattern(REFERENCE_PATTERN)


# ---------------------------------------------------------------- I1 ----
def score_logs(logs: DataFrame, acts: DataFrame) -> DataFrame:
    """Points of a log from its activity's hourly rate."""
    a = acts.select(F.col("id").alias("activity_id"), F.col("points").alias("rate"))
    j = logs.select("id", "user_id", "activity_id", "duration").join(a, "activity_id")
    return j.select("id", "user_id", "duration", "rate",
                    score_points(F.col("duration"), F.col("rate")).alias("points"))


# ---------------------------------------------------------------- I2 ----
def extract_activities(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(activity, duration) pairs from extractor text.

    No match → 'Invalid input'; a duration beyond 64 bits → 'Invalid
    duration format' and the whole text is rejected; the same name twice →
    the last one wins; names keep trailing spaces. Everything is computed
    inside the row (arrays + higher-order functions): no shuffle."""
    names = F.regexp_extract_all("text", F.lit(EXTRACT_PATTERN), 1)
    durs = F.regexp_extract_all("text", F.lit(EXTRACT_PATTERN), 2)
    extra = [c for c in texts.columns if c not in ("id", "user_id", "text")]  # carried along
    t = texts.select("id", "user_id", *extra, names.alias("_n"), durs.alias("_d"))
    pairs = F.transform("_n", lambda n, i: F.struct(
        n.alias("activity"), F.element_at("_d", i + 1).alias("raw"), i.alias("pos")))
    t = t.withColumn("_p", pairs)
    bad_dur = F.exists("_p", lambda p: p["raw"].try_cast("bigint").isNull())
    reason = (F.when(F.size("_n") == 0, F.lit("Invalid input"))
              .when(bad_dur, F.lit("Invalid duration format")))
    t = t.withColumn("_reason", reason)
    keep = F.filter("_p", lambda p: ~F.exists("_p", lambda q: (q["activity"] == p["activity"]) & (q["pos"] > p["pos"])))
    good = (t.where(F.col("_reason").isNull())
            .select("id", "user_id", *extra, F.size(keep).alias("n_activities"), F.inline(keep))
            .select("id", "user_id", "activity", F.col("raw").try_cast("bigint").alias("duration"), "pos",
                    "n_activities", *extra))
    rejects = t.where(F.col("_reason").isNotNull()).select("id", "user_id", F.col("_reason").alias("reason"))
    return good, rejects


# ---------------------------------------------------------------- I3 ----
def _norm(c):
    return F.lower(F.trim(c))


_SEGMENT = "substring({s}, cast({m} * i div {parts} as int) + {d} + 1, cast({m} * (i + 1) div {parts} as int) - cast({m} * i div {parts} as int))"


def _index_keys(name: str, edits: int):
    """Keys that a catalog name is found by: itself, and its ``edits`` + 1 equal segments, one of which any string
    within ``edits`` edits has unchanged."""
    seg = _SEGMENT.format(s=name, m=f"length({name})", d=0, parts=edits + 1)
    return F.expr(f"concat(array(struct(-1 as m, 0 as i, {name} as s)), transform(sequence(0, {edits}), i -> struct(length({name}) as m, i, {seg} as s)))")


def _probe_keys(name: str, canons: str, edits: int):
    """Keys that an extracted name looks under: itself and its synonyms whole, and, for every length within ``edits``
    of its own, the substrings that can be the unchanged segment i: shifted by at most i from the left and by at most
    ``edits`` - i from the right (the substring selection of the published Pass-Join algorithm). A few keys per name,
    whatever its length."""
    seg = _SEGMENT.format(s=name, m="m", d="d", parts=edits + 1)
    low, high = (f"greatest(-i, length({name}) - m - ({edits} - i))", f"least(i, length({name}) - m + ({edits} - i))")
    shifts = f"if({low} <= {high}, sequence({low}, {high}), cast(array() as array<int>))"
    per = f"transform({shifts}, d -> struct(m, i, {seg} as s))"
    near = f"flatten(flatten(transform(sequence(greatest(length({name}) - {edits}, 0), length({name}) + {edits}), m -> transform(sequence(0, {edits}), i -> {per}))))"
    whole = f"transform(array_union(array({name}), coalesce({canons}, cast(array() as array<string>))), c -> struct(-1 as m, 0 as i, c as s))"
    return F.expr(f"array_distinct(concat({whole}, {near}))" if edits > 0 else whole)


def match_activities(extracted: DataFrame, acts: DataFrame, synonyms: DataFrame, max_edits: int = 1) -> DataFrame:
    """Match each extracted name against that user's catalog: equal
    after lower/trim, equal through the synonym table, or within
    ``max_edits`` edits. Replaces the reference's per-pair model call.

    A user logs the same few names over and over, so each name of a user is
    matched once. Catalog names are indexed by themselves and by their
    segments, extracted names look these up (see ``_probe_keys``): one
    equi-join on (user, key), then the exact test on what meets. No name is
    compared with a whole catalog, no catalog is gathered, and nothing is
    broadcast by hint. The matches of a name (a few catalog rows) are sorted
    by activity id and joined to the extracted rows on (user, name)."""
    syn = synonyms.groupBy(_norm("term").alias("_key")).agg(F.collect_set(_norm("canonical")).alias("_canons"))
    cat = acts.select("user_id", F.struct(F.col("id").alias("activity_id"), "name", "points", "activity_type").alias("_act"), _norm("name").alias("_cname"))
    index = cat.select("user_id", "_act", "_cname", F.explode(_index_keys("_cname", max_edits)).alias("_k"))
    names = extracted.select("user_id", _norm("activity").alias("_key")).distinct().join(syn, "_key", "left")
    probe = names.select("user_id", "_key", "_canons", F.explode(_probe_keys("_key", "_canons", max_edits)).alias("_k"))
    exact = (F.col("_cname") == F.col("_key")) | F.coalesce(F.array_contains("_canons", F.col("_cname")), F.lit(False))
    if max_edits > 0:
        exact = exact | (F.levenshtein("_cname", "_key", max_edits) >= 0)
    found = (probe.join(index, ["user_id", "_k"]).where(exact).groupBy("user_id", "_key")
             .agg(F.array_sort(F.collect_set("_act")).alias("matched")))
    none = F.array().cast(T.ArrayType(cat.schema["_act"].dataType))
    return (extracted.withColumn("_key", _norm("activity")).join(found, ["user_id", "_key"], "left")
            .select(*extracted.columns, F.coalesce("matched", none).alias("matched")).withColumn("n_matched", F.size("matched")))


# ---------------------------------------------------------------- I4 ----
def classify_matches(matched: DataFrame) -> DataFrame:
    """I4: one match → 'log'; several → 'ambiguous' (name kept only when the
    text named several activities); none → 'unknown' (name kept)."""
    n = F.col("n_matched")
    outcome = F.when(n == 1, F.lit("log")).when(n > 1, F.lit("ambiguous")).otherwise(F.lit("unknown"))
    name = (F.when(n == 0, F.col("activity"))
            .when((n > 1) & (F.col("n_activities") > 1), F.col("activity")))
    extra = [c for c in matched.columns if c not in ("id", "user_id", "activity", "duration", "n_matched",
                                                     "matched", "pos", "n_activities")]
    return matched.select("id", "user_id", "activity", outcome.alias("outcome"), "duration", name.alias("name"),
                          "n_matched", "matched", "pos", "n_activities", *extra)


# ---------------------------------------------------------------- I5 ----
def daily_cap_admission(logs: DataFrame, cap: int = DAILY_MINUTES_CAP, keep: tuple[str, ...] = (),
                        order: tuple[str, ...] = ("id",)) -> DataFrame:
    """In (logged_at, ``order``) order per user-day accept a log iff
    accepted minutes + duration ≤ cap; a rejected log adds nothing. Rows with
    ``forced`` true (already stored logs) always count and are always
    accepted; a NULL duration adds nothing and is accepted within the cap.
    Columns in ``keep`` ride along with each row.

    Not a window sum: the state depends on earlier decisions. One shuffle on
    (user, day) and a sort inside each task put every user-day in order; the
    rows then stream past one running count per user-day. Nothing is
    gathered, so a user-day of any size takes the memory of one batch, and
    all user-days take the same path."""
    forced = F.coalesce("forced", F.lit(False)) if "forced" in logs.columns else F.lit(False)
    kept = [c for c in dict.fromkeys((*order, *keep)) if c not in ("id", "user_id", "logged_at")]
    rows = logs.select("id", "user_id", F.to_date("logged_at").alias("day"), "logged_at",
                       F.col("duration").cast("bigint").alias("d"), forced.alias("forced"), *kept)
    runs = rows.repartition("user_id", "day").sortWithinPartitions("user_id", "day", "logged_at", *order)
    schema = T.StructType(rows.schema.fields + [T.StructField("accepted", T.BooleanType()), T.StructField("minutes_after", T.LongType())])
    out = runs.mapInArrow(_admitter(cap, [rows.columns.index(c) for c in ("user_id", "day", "d", "forced")]), schema)
    return out.select("user_id", "day", "id", "accepted", "minutes_after", "logged_at", "forced", "d",
                      *[c for c in keep if c in kept])


def _admitter(cap: int, at: list[int]):
    """Decisions along a task's sorted rows: one count, started anew with each user-day."""
    def run(batches):
        import pyarrow as pa
        key, minutes = None, 0
        for b in batches:
            accepted, after = [], []
            for user, day, d, forced in zip(*[b.column(i).to_pylist() for i in at]):
                if (user, day) != key:
                    key, minutes = (user, day), 0
                ok = forced or minutes + (d or 0) <= cap
                if ok:
                    minutes += d or 0
                accepted.append(ok)
                after.append(minutes)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(accepted, pa.bool_()), pa.array(after, pa.int64())],
                                             names=[*b.schema.names, "accepted", "minutes_after"])
    return run


# ---------------------------------------------------------------- I6 ----
LOG_REQUEST_SCHEMA = T.StructType([
    T.StructField("activity_id", T.StringType()), T.StructField("activity_name", T.StringType()),
    T.StructField("activity_points", T.IntegerType()), T.StructField("activity_duration", T.IntegerType()),
    T.StructField("activity_description", T.StringType()), T.StructField("one_time", T.StringType()),
])


def ingest_structured_logs(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed log requests (see S3) → (new custom activities, logs).

    kind 'specific' (activity_id given), 'one_time' (activity_id NULL, the
    name ignored) or 'new' (a 'custom' activity is created too). Points use
    the request's rate; no cap check on this path. Ids derive from the
    request id (see ``functions.ids``), so a replayed batch writes the same
    rows; given activity ids are kept as they are, as text."""
    r = requests.withColumn(
        "kind", F.when(F.col("activity_id").isNotNull(), F.lit("specific"))
        .when(F.col("one_time") == "true", F.lit("one_time")).otherwise(F.lit("new")))
    made = new_id("activity", "id")
    new_acts = r.where(F.col("kind") == "new").select(
        made.alias("id"), "user_id", F.col("activity_name").alias("name"),
        F.col("activity_points").alias("points"), F.lit("custom").alias("activity_type"))
    act = (F.when(F.col("kind") == "specific", F.col("activity_id"))
           .when(F.col("kind") == "new", made))
    logs = r.select(new_id("log", "id").alias("id"), F.col("id").alias("request_id"), "user_id", act.alias("activity_id"), F.col("activity_duration").alias("duration"),
                    score_points(F.col("activity_duration"), F.col("activity_points")).alias("points"),
                    "activity_description", "logged_at", "kind")
    return new_acts, logs


# ---------------------------------------------------------------- I8 ----
def seed_default_catalog(users: DataFrame) -> DataFrame:
    """I8: the 10 default activities for every opted-in user. The catalog
    is a fixed literal array exploded per row — no join."""
    cat = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("name"), F.lit(p).alias("points"))
                    for k, (n, p) in enumerate(DEFAULT_CATALOG)])
    return (users.where(F.col("set_default")).select(F.col("id").alias("user_id"), F.inline(cat))
            .select(new_id("default_activity", "user_id", "k").alias("id"), "user_id", "name", "points",
                    F.lit("default").alias("activity_type")))
