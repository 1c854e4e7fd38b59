r"""Mixing sources to target weights by Sainte-Lague apportionment (op6).

Targets are water-filled over the sources; then whole blocks of ``BLOCK`` tokens are apportioned twice by highest
quotients (votes / 1, 3, 5 ...): from the mix to the sources, and from each source to its shards. A shard lays its
documents end to end in a seeded order and cuts that line into blocks; a quota of q of its n blocks takes every block
q div n times, and q mod n of them, spread evenly from a seeded start, once more. A document takes what the chosen
blocks hold of it.

Only (id, source, size, text hash) is shuffled, by source and shard; a source has one shard per ``SHARD`` tokens, so
that a hot source is many groups. ``mixture`` emits the chosen words: it numbers the rows in a stored copy, so that alike
rows keep their own places on the line, and joins the choice to it by that number.

Cases: null text has size 0 and takes nothing; null is a source of its own, ordered last; repeated rows are rows of
their own (rows alike in id, source and text trade places without effect); an empty table gives no rows; no words at
all give targets of 0; other columns are ignored (``mix``) or kept (``mixture``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import computed, rows_by_range, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 32
SHARD = 1 << 20
SEED = 20240115


def targets(sources: DataFrame, share: float = SHARE) -> DataFrame:
    """(source, source_size) -> with ``at``, the place by code point (null last), and ``target``.

    Sources that reach ``MOST`` times their size stop there, the rest is shared anew by weight, until none is above."""
    placed = stored(rows_by_range(sources, [F.col("source").isNull(), F.col("source")], "at"), "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("at") % len(WEIGHTS) + 1).cast("int"))
    placed = placed.withColumn("weight", weight.cast("double")).withColumn("most", (MOST * F.col("source_size")).cast("double"))
    total = share * float(placed.agg(F.sum("source_size")).first()[0] or 0)
    rate, full = 0.0, -1
    while True:  # the rate only rises, so every round fills at least one more source or is the last
        capped = F.col("weight") * rate > F.col("most")
        s = placed.agg(F.sum(F.when(capped, F.col("most"))).alias("full"), F.sum(F.when(~capped, F.col("weight"))).alias("weight"), F.count(F.when(capped, 1)).alias("n")).first()
        if s["n"] == full or not s["weight"]:
            break
        full, rate = s["n"], (total - (s["full"] or 0.0)) / s["weight"]
    return placed.withColumn("target", F.least(F.col("weight") * rate, F.col("most"))).drop("weight", "most")


def apportion(parties: DataFrame, key: str, votes: str, seats: Column, order: str, within: str | None = None) -> DataFrame:
    """(key, quota) of each party: ``seats`` (of its group ``within``, or of all) by highest Sainte-Lague quotients, ties
    to the lower ``order``.

    Between the divisors (sum of votes) / (seats -+ half the parties) lie all outcomes, so a party has seats it gets for
    certain and a few open ones; only the open ones are ranked, about three per party."""
    group = [within] if within else []
    sums = parties.groupBy(*group).agg(F.sum(votes).alias("_v"), F.count("*").alias("_n"), F.first(seats).alias("_seats"))
    if group:
        df = parties.join(sums, group)
    else:
        one = sums.first()
        df = parties.withColumns({c: F.lit(one[c]) for c in ("_v", "_n", "_seats")})
    sure = F.when(F.col("_seats") > F.col("_n") / 2, F.floor(F.col(votes) * (F.col("_seats") - F.col("_n") / 2) / F.col("_v") + 0.5)).otherwise(F.lit(0)).cast("long")
    most = F.floor(F.col(votes) * (F.col("_seats") + F.col("_n") / 2) / F.col("_v") + 0.5).cast("long") + 1
    df = df.withColumn("_sure", F.when(F.col("_v") > 0, sure).otherwise(0)).withColumn("_most", F.when(F.col("_v") > 0, most).otherwise(0))
    df = stored(df.select(key, *[c for c in (within, order) if c and c != key], votes, "_seats", "_sure", "_most"), "parties")
    open_ = (df.withColumn("j", F.explode(F.when(F.col("_most") > F.col("_sure"), F.sequence("_sure", F.col("_most") - 1)).otherwise(F.array().cast("array<bigint>"))))
             .withColumn("_q", F.col(votes) / (2 * F.col("j") + 1)))
    left = df.groupBy(*group).agg((F.first("_seats") - F.sum("_sure")).alias("_left"))
    if within:
        won = (open_.withColumn("r", F.row_number().over(Window.partitionBy(within).orderBy(F.desc("_q"), order, "j")))
               .join(left, within).where("r <= _left"))
    else:
        won = open_.orderBy(F.desc("_q"), order, "j").limit(max(0, int((left.first() or [0])[0] or 0)))  # at most one seat per party
    extra = won.groupBy(key).agg(F.count("*").alias("_more"))
    return df.join(extra, key, "left").select(key, (F.col("_sure") + F.coalesce("_more", F.lit(0))).alias("quota"))


def _measured(docs: DataFrame, *keep: str) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("_t"), *keep)


def _placed(rows: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """Rows with shard and span on its line; and the shards with their quotas."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    shared = stored(targets(sources), "targets")
    total = shared.agg(F.sum("target")).first()[0] or 0.0
    quotas = apportion(shared, "at", "target", F.lit(round(total / BLOCK)), "at").withColumnRenamed("quota", "source_quota")
    shared = shared.join(quotas, "at").withColumn("shards", F.greatest(F.ceil(F.col("source_size") / SHARD), F.lit(1)).cast("long"))
    dealt = rows.join(shared, rows["source"].eqNullSafe(shared["source"])).drop(shared["source"])
    seeded = F.xxhash64(F.lit(SEED), "doc_id", "_t")
    dealt = dealt.withColumn("_h", seeded).withColumn("shard", F.pmod(F.xxhash64(F.lit(SEED + 1), "_h"), F.col("shards")))
    line = Window.partitionBy("at", "shard").orderBy("_h", "doc_id", "_t", *keep)
    dealt = stored(dealt.withColumn("_hi", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))), "line")
    shards = (dealt.groupBy("at", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
              .withColumn("cell", F.struct("at", "shard")))
    got = apportion(shards, "cell", "shard_size", F.col("source_quota"), "shard", within="at")
    return dealt, shards.join(got, "cell").select("at", "shard", "shard_size", F.col("quota"))


def _chosen_blocks(k: Column) -> Column:
    """How many of the first k blocks of a shard are taken once more: block b is one if this rises from b to b + 1."""
    return F.floor((k * F.col("_rest") + F.col("_from")) / F.col("_n"))


def mix_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source, _t, size, source_size, target, taken of every row; with the columns ``keep``, which order alike
    rows, also these, the number of whole passes (_each), of words in the pass over some blocks (_some), the row's place
    on its line (_lo) and what tells the chosen blocks (_rest, _from, _n)."""
    dealt, shards = _placed(stored(_measured(docs, *keep), "sizes"), *keep)
    n = F.greatest(F.ceil(F.col("shard_size") / BLOCK), F.lit(1)).cast("long")
    shards = shards.withColumn("_n", n).withColumn("_q", F.least(F.col("quota"), MOST * F.col("_n")))
    shards = shards.select(F.col("at").alias("_at"), F.col("shard").alias("_shard"), "_n", F.expr("_q div _n").alias("_each"), (F.col("_q") % F.col("_n")).alias("_rest"),
                           F.pmod(F.xxhash64(F.lit(SEED + 2), "at", "shard"), F.col("_n")).alias("_from"))
    df = dealt.join(shards, (F.col("at") == F.col("_at")) & (F.col("shard") == F.col("_shard")))

    def chosen(x: Column) -> Column:
        """Tokens of the blocks chosen once more in front of token x."""
        b = F.floor(x / BLOCK)
        return BLOCK * _chosen_blocks(b) + (_chosen_blocks(b + 1) - _chosen_blocks(b)) * (x - BLOCK * b)

    some = chosen(F.col("_hi")) - chosen(F.col("_hi") - F.col("size"))
    taken = F.col("_each") * F.col("size") + some
    more = [*keep, "_each", F.when(F.col("size") > 0, some).otherwise(0).cast("long").alias("_some"), (F.col("_hi") - F.col("size")).alias("_lo"), "_rest", "_from", "_n"] if keep else []
    return df.select("doc_id", "source", "_t", "size", "source_size", "target", F.when(F.col("size") > 0, taken).otherwise(0).cast("long").alias("taken"), *more)


def mix(docs: DataFrame) -> DataFrame:
    return mix_rows(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixture(docs: DataFrame) -> DataFrame:
    """What the mix takes of ``docs``: a row for each pass over a document, with ``mix_size`` (words of the document),
    ``mix_target`` (words of its source) and ``mix_taken`` (words of this row) added. A pass over some blocks has in
    ``text`` their words, each with the white space behind it, and ``n_chars``, where there is such a column, set to the
    new length."""
    packed = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.monotonically_increasing_id().alias("_id")), "rows")
    plan = (mix_rows(packed.select("_row.doc_id", "_row.source", "_row.text", "_id"), "_id").where("taken > 0")
            .select("_id", F.col("size").alias("_size"), "target", "_each", "_some", "_lo", "_rest", "_from", "_n"))
    whole = F.array_repeat(F.col("_size"), F.col("_each").cast("int"))
    passes = F.when(F.col("_some") > 0, F.concat(whole, F.array("_some"))).otherwise(whole)
    rows = packed.join(plan, "_id").withColumn("_taken", F.explode(passes))

    def taken(_, i):
        b = F.floor((F.col("_lo") + i) / BLOCK)
        return _chosen_blocks(b + 1) > _chosen_blocks(b)

    cut = F.col("_taken") < F.col("_size")
    words = F.regexp_extract_all(F.col("_row.text"), F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    rows = rows.withColumn("_new", computed(F.when(cut, F.array_join(F.filter(words, taken), "")).otherwise(F.col("_row.text"))))
    columns = [F.col("_new").alias(c) if c == "text" else F.when(cut, F.length("_new").cast(docs.schema[c].dataType)).otherwise(F.col(f"_row.`{c}`")).alias(c)
               if c == "n_chars" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return rows.select(*columns, F.col("_size").alias("mix_size"), F.col("target").alias("mix_target"), F.col("_taken").alias("mix_taken"))
