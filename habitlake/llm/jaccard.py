"""N-gram Jaccard self-join by grouped prefixes (op5).

A document is the set of its distinct word n-grams. Grams are ordered from rare to frequent (a counting sketch over all
documents), and documents that agree in the first grams of that order and in size form one group. Groups that share a
prefix gram are paired under size and overlap bounds and pairs are expanded to the members. A parity sketch of each set
(one or two bits a gram) bounds the difference of a pair's sets from below, which drops most pairs that are no links and
never one that is; the members left are verified on their whole sets.

Two sets of a and b grams are linked only if c = percent (a + b) / (100 + percent) of them are common, and the first
common gram in the order has all common ones behind it: so a pair counts in a posting list only where both sets have c
grams from that gram on. A set that has more rare grams of its own than a link can bear is met by none.

Only what decides the components is paired: in each group every member with the least one, and in each posting list
every group with the one in which the gram stands first (the copy with the least of its own in front, so that most near
copies hang on it); then, once the links found have been joined to components, groups and members of different
components. A pair left out lies in one component already, so no link between components is lost. All bounds, and that
components differ, are conditions of the joins, so that pairs which fail them are never made; long posting lists are
dealt to several tasks. Texts are shuffled for the sets to verify, and whole rows where their id may go or is repeated,
only: behind a bit table of the wanted ids.

Cases: null or wordless text has the empty set and stands alone; rows with one text count as one set; a component of
rows without an id has a null component_id; rows that repeat an id are compared as rows of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, stored, tasks
from .components import components
from .words import LOWER, NOT_SPACE, ngram_hashes, split_words, splitmix, text_chunks

#: the counting sketch has 2**SKETCH_BITS counters (8 bytes each; 1 byte each once on a log scale), whatever the input
SKETCH_BITS = 20
_PART = 1 << 14
#: a posting list is dealt to one task for each so many of its groups
LIST_PART = 4096
#: the filter in front of the join that fetches texts has 2**FILTER_BITS bits (2 MB), whatever the input
FILTER_BITS = 24


def sets_of(column: pa.Array, n: int):
    """The sorted distinct n-gram hashes of each text (the whole text as one where it has fewer words)."""
    for _, _, buf, offs in text_chunks(column):
        w = split_words(LOWER[buf], offs, NOT_SPACE)
        h = w.hashes()
        grams = ngram_hashes(h, n)
        for lo, hi in zip(w.first[:-1], w.first[1:]):
            if hi - lo >= n:
                yield np.unique(grams[lo:hi - n + 1])  # positions lo .. hi-n lie inside this text
            elif hi > lo:
                yield splitmix(ngram_hashes(h[lo:hi], int(hi - lo)) + np.uint64(hi - lo))
            else:
                yield np.zeros(0, np.uint64)


def _bins(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequency_scale(docs: DataFrame, n: int) -> np.ndarray:
    """For each counter of the sketch: a byte that grows with the number of documents' grams that fall to it."""
    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            for s in sets_of(b.column(0), n):
                np.add.at(total, _bins(s), 1)
        parts = total.reshape(-1, _PART)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "counts"])

    def add(batches):
        total = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                total[k] = total.get(k, 0) + np.frombuffer(x.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([
            np.minimum(np.round(6 * np.log2(p + 1.0)), 255).astype(np.uint8).tobytes() for p in total.values()], pa.binary())], names=["part", "counts"])

    kind = "part int, counts binary"
    parts = docs.select("text").mapInArrow(count, kind).repartition(tasks(docs.sparkSession), "part").mapInArrow(add, kind).collect()
    scale = np.zeros(((1 << SKETCH_BITS) // _PART, _PART), np.uint8)
    for r in parts:
        scale[r["part"]] = np.frombuffer(r["counts"], np.uint8)
    return scale.reshape(-1)


def prefix_length(size: int, percent: int) -> int:
    """So many first grams meet those of any set of at least ``percent`` % Jaccard similarity."""
    return size - -(-percent * size // 100) + 1 if size else 0


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """The parity of the number of grams in each of m slots, m the least power of two from the set's size on (64 at
    least), as m / 64 words. Two sets differ in one gram at least for each slot in which their parities differ."""
    m = max(64, 1 << max(len(s) - 1, 0).bit_length())
    odd = np.bincount((splitmix(s) & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


SETS = T.StructType([T.StructField("n", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("grp", T.LongType()),
                     T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("parity", T.ArrayType(T.LongType()))])


def _describe(shared, n: int, percent: int):
    """Per text: set size, identity of the set, identity of (size, prefix), the prefix grams, rarest first, and the
    parity sketch."""
    def make():
        scale = shared.value

        def run(column: pa.Array) -> list:
            size, node, grp, flat, ends = [], [], [], [np.zeros(0, np.int64)], [0]
            odd, stops = [np.zeros(0, np.int64)], [0]
            for s in sets_of(column, n):
                p = prefix_length(len(s), percent)
                first = s[np.lexsort((s, scale[_bins(s)]))[:p]]
                size.append(len(s))
                node.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                key = hashlib.blake2b(first.tobytes() + len(s).to_bytes(8, "little"), digest_size=8).digest()
                grp.append(int.from_bytes(key, "little", signed=True))
                flat.append(first.view(np.int64))
                ends.append(ends[-1] + p)
                odd.append(parity_sketch(s))
                stops.append(stops[-1] + len(odd[-1]))
            return [pa.array(size, pa.int64()), pa.array(node, pa.binary()), pa.array(grp, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat), pa.int64())),
                    pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(np.concatenate(odd), pa.int64()))]
        return run
    return make


def _odd_slots(x, y):
    """Slots in which two sketches differ, the longer one folded to the shorter one's length; null where one is more than
    twice as long."""
    def folded(c, to):
        half = F.size(c) / 2
        return F.when(F.size(c) == F.size(to), c).when(F.size(c) == 2 * F.size(to), F.zip_with(
            F.slice(c, 1, half.cast("int")), F.slice(c, (half + 1).cast("int"), half.cast("int")), lambda a, b: a.bitwiseXOR(b)))

    short = F.size(x) <= F.size(y)
    differ = F.zip_with(F.when(short, x).otherwise(folded(x, y)), F.when(short, folded(y, x)).otherwise(y), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.aggregate(differ, F.lit(0), lambda a, v: a + v)


def _few_differ(percent: int, m: str, n: str, x: str, y: str):
    """Not so many slots of the sketches x and y differ that sets of sizes m and n cannot be similar enough."""
    slots = F.coalesce(_odd_slots(F.col(x), F.col(y)), F.lit(0))
    return (100 + percent) * slots <= (100 - percent) * (F.col(m) + F.col(n))


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) less those whose sketches show that their sets differ in too many grams: sets of sizes m and n have at
    least `percent` % similarity only if they differ in (100 - percent) / (100 + percent) of m + n grams at most."""
    side = lambda name, n, odd: nodes.select(F.col("node").alias(name), F.col("n").alias(n), F.col("parity").alias(odd))
    both = pairs.join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b")
    return both.where(_few_differ(percent, "m", "n", "x", "y")).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose whole sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return (pairs.join(right, "b").join(left, "a").withColumn("c", common)
            .where(100 * F.col("c") >= percent * (F.size("x") + F.size("y") - F.col("c"))).select("a", "b").distinct())


def _slot(column):
    """One of 2**FILTER_BITS slots; a null has one of its own hash too."""
    return F.shiftrightunsigned(F.xxhash64(column), 64 - FILTER_BITS)


def _marked(rows: DataFrame, column: str, wanted: DataFrame, name: str) -> DataFrame:
    """``rows`` with a column ``name``: true where ``column`` is in the one column of ``wanted``, and false for most of the
    others, without a shuffle of ``rows``: a table of bits, of a fixed size whatever the input, tells which slots are
    wanted. Only the slots go through Python."""
    def mark(batches):
        bits = np.zeros(1 << FILTER_BITS, bool)
        for b in batches:
            bits[b.column(0).to_numpy()] = True
        parts = np.packbits(bits).reshape(-1, _PART)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[k].tobytes() for k in used], pa.binary())], names=["part", "bits"])

    def unite(batches):
        total = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                total[k] = total.get(k, 0) | np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([p.tobytes() for p in total.values()], pa.binary())], names=["part", "bits"])

    kind = "part int, bits binary"
    spark = rows.sparkSession
    parts = wanted.select(_slot(wanted.columns[0])).mapInArrow(mark, kind).repartition(tasks(spark), "part").mapInArrow(unite, kind).collect()
    table = np.zeros(((1 << FILTER_BITS) // 8 // _PART, _PART), np.uint8)
    for r in parts:
        table[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(table.reshape(-1))

    def look(slot: pa.Array) -> pa.Array:
        s = slot.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1)

    return rows.withColumn(name, F.arrow_udf(look, "boolean")(_slot(column)))


def _among(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``rows`` less most of those whose ``column`` is not in the one column of ``wanted``, and none of the others, without a
    shuffle of ``rows``."""
    return _marked(rows, column, wanted, "_wanted").where("_wanted").drop("_wanted")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, grams) of the wanted nodes (node, doc_id of one row that has it); rows alike in id and text repeat it."""
    def make():
        def run(column: pa.Array) -> list:
            nodes, flat, ends = [], [np.zeros(0, np.int64)], [0]
            for s in sets_of(column, n):
                nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                flat.append(s.view(np.int64))
                ends.append(ends[-1] + len(s))
            return [pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat), pa.int64()))]
        return run

    maybe = _among(docs.select(F.col("doc_id").alias("_id"), "text"), "_id", wanted.select("doc_id"))
    rows = maybe.join(wanted, F.col("_id").eqNullSafe(F.col("doc_id"))).select("text", F.col("node").alias("want"))
    added = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("grams", T.ArrayType(T.LongType()))])
    return annotate(rows, "text", added, make).where("node = want").select("node", "grams")


def link_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequency_scale(docs, n))
    rows = stored(annotate(docs, "text", SETS, _describe(shared, n, percent)).drop("text"), "sets")
    some = rows.where("n > 0")
    # the distinct sets, each with one of its rows, and the groups of equal size and prefix
    nodes = stored(some.groupBy("node", "grp", "n").agg(F.min("doc_id").alias("doc_id"), F.first("parity").alias("parity")), "nodes")
    groups = some.groupBy("grp", "n").agg(F.first("prefix").alias("prefix"))
    heads = stored(nodes.groupBy("grp", "n").agg(F.min("node").alias("head")), "heads")
    # posting lists of the prefix grams that several groups have
    entries = groups.select("grp", "n", F.posexplode("prefix").alias("pos", "gram"))
    posting = stored(entries.select("gram", "grp", "n", "pos", F.count("*").over(Window.partitionBy("gram")).alias("many")).where("many > 1"), "posting")

    # round 1: each group's members with its head; each posting list's groups with that in which the gram stands first
    inner = nodes.join(heads, ["grp", "n"]).where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    centre = posting.groupBy("gram").agg(F.min(F.struct("pos", "n", "grp")).alias("c")).select(
        "gram", F.col("c.pos").alias("pos0"), F.col("c.n").alias("n0"), F.col("c.grp").alias("grp0"))
    star = (posting.join(centre, "gram").where("grp <> grp0 OR n <> n0").where(_similar(percent, "n", "n0", "pos", "pos0"))
            .select("grp", "n", "grp0", "n0").distinct())
    outer = (star.join(heads, ["grp", "n"])
             .join(heads.select(F.col("grp").alias("grp0"), F.col("n").alias("n0"), F.col("head").alias("head0")), ["grp0", "n0"])
             .select(F.least("head", "head0").alias("a"), F.greatest("head", "head0").alias("b")))
    first = stored(outer.unionAll(inner).distinct(), "pairs")
    links = _link(docs, nodes, stored(_near(first, nodes, percent), "near"), n, percent)
    found = components(links)

    # round 2: what shares a group or a prefix gram but not a component yet
    member = stored(nodes.join(found.select("node", "comp"), "node", "left").select("node", "grp", "n", "parity", F.coalesce("comp", "node").alias("comp")), "member")
    spread = stored(member.groupBy("grp", "n").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")), "spread")
    lists = posting.join(spread, ["grp", "n"])
    mixed = lists.groupBy("gram").agg(F.min("lo").alias("x"), F.max("hi").alias("y")).where("x <> y").select("gram")
    lists = stored(lists.join(mixed, "gram").withColumn("parts", F.ceil(F.col("many") / LIST_PART)), "lists")
    # the smaller set of a pair, or one of the same size, has the gram so far in front; it lies in one part of the list
    small = (lists.where((100 + percent) * (F.col("n") - F.col("pos")) >= 2 * percent * F.col("n"))
             .withColumn("part", F.pmod(F.xxhash64("grp", "n"), F.col("parts"))).drop("parts", "many"))
    large = lists.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(
        "gram", "part", *[F.col(c).alias(c + "2") for c in ("grp", "n", "pos", "lo", "hi")])
    across = (small.join(large, ["gram", "part"])
              .where("(n < n2 OR (n = n2 AND grp < grp2)) AND least(lo, lo2) <> greatest(hi, hi2)")
              .where(_similar(percent, "n", "n2", "pos", "pos2")).select("grp", "n", "grp2", "n2").distinct())
    within = spread.where("lo <> hi").select("grp", "n", F.col("grp").alias("grp2"), F.col("n").alias("n2"))
    second = (across.unionAll(within).join(member, ["grp", "n"])
              .join(member.select(*[F.col(c).alias(c + "2") for c in member.columns]), ["grp2", "n2"])
              .where("comp <> comp2 AND (grp <> grp2 OR n <> n2 OR node < node2)").where(_few_differ(percent, "n", "n2", "parity", "parity2"))
              .select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")))
    rest = stored(second.distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    more = _link(docs, nodes, rest, n, percent)
    label = found.select("node", "comp")
    joined = (more.join(label.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left")
              .join(label.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
              .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    top = components(joined).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    final = (member.select("node", "comp").join(top, "comp", "left")
             .select("node", F.coalesce("top", "comp").alias("comp")))
    lowest = final.join(nodes.select("node", "doc_id"), "node").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = final.join(lowest, "comp").select("node", "component_id")
    whole = rows.select("doc_id", "n", "node").join(named, "node", "left")
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _similar(percent: int, a: str, b: str, i: str, j: str):
    """Sets of sizes a and b whose first common gram has the places i and j can be similar enough: their sizes allow it,
    and each has as many grams from there on as have to be common."""
    behind = F.least(F.col(a) - F.col(i), F.col(b) - F.col(j))
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((100 + percent) * behind >= percent * (F.col(a) + F.col(b)))


def _link(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    sets = stored(_sets(docs, nodes.join(wanted, "node").select("node", "doc_id"), n), "grams")
    return stored(_verified(pairs, sets, percent), "links")


def one_of_each(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """The rows of ``docs``, unchanged, less the near duplicates: of each component only the document with its smallest
    id stays. Rows without an id, and rows without words, all stay; where the staying id is repeated, one row of each
    text stays."""
    found = stored(link_components(docs, n, percent), "components").where("n_shingles > 0")
    going = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    twice = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_twice"))
    # an id that stays for one component is kept even if another row of that id goes
    going = stored(going.distinct().join(found.where("doc_id = component_id").select(F.col("doc_id").alias("_gone")), "_gone", "left_anti"), "going")
    # rows of other ids stay as they are, unshuffled
    marked = _marked(docs, "doc_id", going.unionAll(twice), "_look")
    kept = marked.where("_look").drop("_look").join(going, F.col("doc_id") == F.col("_gone"), "left_anti")
    once = kept.join(twice, F.col("doc_id") == F.col("_twice"), "left_anti")
    repeated = kept.join(twice, F.col("doc_id") == F.col("_twice"), "left_semi").dropDuplicates(["doc_id", "text"])
    return marked.where("NOT _look").drop("_look").unionAll(once).unionAll(repeated)
