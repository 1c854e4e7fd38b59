"""Phrase collocations by sorted count streams (op11).

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and those into words at spaces and tabs.
Everything is per language. A phrase's score is the least, over its cuts into two parts, of
floor(1000 * count * words / (count of the first part * count of the second)).

* Counting goes by length, from the empty phrase (all words) to ``max_words``: a pass over the texts counts the phrases
  of one length whose two parts one word shorter both reached the threshold, as all parts of a frequent phrase do. Tasks
  know those parts by a bit table of a fixed size (``FILTER_BITS``): it lets some rare phrases through, which the exact
  counts then drop, and never loses one. Counts are combined in the task before the shuffle.
* The frequent phrases of all lengths are one stream in prefix order (by words) and one in suffix order (by words from
  the last). Walking down a sorted stream, the phrases that begin the present one lie on a stack: the merge of all
  lengths' streams in lockstep. That gives the counts of all first parts in prefix order, of all last parts in suffix
  order, and which phrases a one-word extension equals in count. (A longer phrase as frequent as one that it contains
  implies such an extension.) Streams are cut into ranges of rows, wherever that falls; what a range's first row needs
  from before is handed to it, five counts a range.

Arithmetic is exact (decimals of 38 digits). Cases: null and empty texts have no words; null languages count as
``und``; repeated rows count each; very long texts are taken in blocks of words; empty tables give an empty table;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, tasks
from .words import LOWER, Words, ngram_hashes, split_words, splitmix, text_chunks

THRESHOLD, TOP, MAX_WORDS = 100, 2000, 5
#: bytes of text and words taken at once
CHUNK, BLOCK = 1 << 22, 1 << 19
#: bits of the table of frequent parts, and of one block of it as it is put together
FILTER_BITS, FILTER_BLOCK = 1 << 27, 1 << 16
BREAK = np.zeros(256, bool)
BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
MEMBER = ~BREAK
MEMBER[list(b" \t")] = False


def _language(lang: str) -> np.uint64:
    return splitmix(zlib.crc32(lang.encode()))


def _places(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(FILTER_BITS)).astype(np.int64)


# ------------------------------------------------------------ counts ----
def _blocks(texts: pa.Array, langs: pa.Array, n: int) -> Iterator[tuple[Words, np.ndarray, np.ndarray, int]]:
    """(words, language of each, whether each lies in one piece with the next, number of words that phrases begin at),
    block by block; the n-1 words after a block come with it."""
    lang_of = langs.to_numpy(zero_copy_only=False)
    for lo, _, buf, offs in text_chunks(texts, CHUNK):
        buf = LOWER[buf]
        w = split_words(buf, offs, MEMBER)
        docs = w.docs()
        piece = np.searchsorted(np.flatnonzero(BREAK[buf]), w.starts)
        joined = np.append((docs[1:] == docs[:-1]) & (piece[1:] == piece[:-1]), False)
        for a in range(0, len(w.starts), BLOCK):
            b, last = min(a + BLOCK, len(w.starts)), min(a + BLOCK + n - 1, len(w.starts))
            at = w.starts[a]
            part = Words(buf[at:w.ends[last - 1]], w.starts[a:last] - at, w.ends[a:last] - at, np.array([0, last - a]))
            yield part, lang_of[lo + docs[a:last]], joined[a:last], b - a


def _phrases(w: Words, lang: np.ndarray, joined: np.ndarray, begin: int, n: int, bits: np.ndarray | None, hashes: list) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(language, phrase, count) of the distinct phrases of n words that begin in the block and pass the filter."""
    total = len(w.starts)
    if total < n:
        return np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(0, np.int64)
    ok = np.zeros(total, bool)
    ok[:max(min(begin, total - n + 1), 0)] = True
    for j in range(n - 1):
        ok[:total - j] &= joined[j:]
    if bits is not None:
        place = _places(ngram_hashes(w.hashes(), n - 1) ^ np.array(hashes, np.uint64)[lang[:total - n + 2]])
        known = np.zeros(total + 1, bool)
        known[:len(place)] = bits[place >> 3] >> (place & 7).astype(np.uint8) & 1
        ok &= known[:-1] & known[1:]
    at = np.flatnonzero(ok)
    if not len(at):
        return np.zeros(0, np.int64), pa.array([], pa.large_string()), at
    used = np.zeros(total, bool)
    for j in range(n):
        used[at + j] = True
    coded = w.column(np.flatnonzero(used)).dictionary_encode()
    ids = np.zeros(total, np.int64)
    ids[used] = coded.indices.to_numpy()
    size, key = len(coded.dictionary), lang[at].astype(np.int64)
    for j in range(n):  # numbers of distinct beginnings, one word longer each time
        _, first, key, count = np.unique(key * size + ids[at + j], return_index=True, return_inverse=True, return_counts=True)
    names = coded.dictionary.cast(pa.large_string())
    words = [names.take(pa.array(ids[at[first] + j])) for j in range(n)]
    return lang[at[first]], pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if n > 1 else words[0], count


COUNTED = T.StructType([T.StructField("gram", T.StringType()), T.StructField("f", T.LongType())])


def _count(docs: DataFrame, n: int, threshold: int, bits) -> DataFrame:
    """lang, phrase and exact count of the phrases of n words that reach the threshold (n = 1: and the empty phrase)."""
    def run(batches):
        table = None if bits is None else bits.value
        for b in batches:
            langs = b.column(0).dictionary_encode()
            names = langs.dictionary.to_pylist()
            for w, lang, joined, begin in _blocks(b.column(1), langs.indices, n):
                which, phrase, count = _phrases(w, lang, joined, begin, n, table, [_language(x) for x in names])
                if n == 1:
                    words = np.bincount(lang[:begin], minlength=len(names))
                    which, count = np.append(which, np.arange(len(names))), np.append(count, words)
                    phrase = pa.concat_arrays([phrase, pa.array([""] * len(names), pa.large_string())])
                prefix = pa.array([f"{x}\t" for x in names], pa.large_string()).take(pa.array(which))
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(prefix, phrase, pa.scalar("", pa.large_string())).cast(pa.string()), pa.array(count, pa.int64())], names=COUNTED.names)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").mapInArrow(run, COUNTED)
    counted = rows.groupBy("gram").agg(F.sum("f").alias("f")).where(F.col("f") >= threshold)
    phrase = F.substring_index("gram", "\t", -1)
    return counted.select(F.expr("left(gram, length(gram) - length(substring_index(gram, '\t', -1)) - 1)").alias("lang"), phrase.alias("phrase"), "f")


def _filter(grams: DataFrame, n: int):
    """The bit table of the phrases of n words, put together on executors block by block; None if there are none."""
    def places(batches):
        for b in batches:
            langs = b.column(0).to_pylist()
            for lo, hi, buf, offs in text_chunks(b.column(1)):
                w = split_words(buf, offs, MEMBER)
                h = ngram_hashes(w.hashes(), n)[w.first[:-1]] ^ np.array([_language(x) for x in langs[lo:hi]], np.uint64)
                p = np.unique(_places(h))
                yield pa.RecordBatch.from_arrays([pa.array(p // FILTER_BLOCK), pa.array(p % FILTER_BLOCK)], names=["block", "place"])

    def pack(batches):
        for b in batches:
            packed = []
            for places in b.column(1).to_pylist():
                bits = np.zeros(FILTER_BLOCK, np.uint8)
                bits[places] = 1
                packed.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["block", "bits"])

    spread = grams.where(F.col("phrase") != "").select("lang", "phrase").mapInArrow(places, "block long, place long")
    blocks = spread.groupBy("block").agg(F.collect_set("place").alias("places")).mapInArrow(pack, "block long, bits binary")
    table, some = np.zeros(FILTER_BITS // 8, np.uint8), False
    for r in blocks.collect():  # at most FILTER_BITS / 8 bytes in all
        at = r["block"] * FILTER_BLOCK // 8
        table[at:at + FILTER_BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
        some = True
    return grams.sparkSession.sparkContext.broadcast(table) if some else None


def frequent(docs: DataFrame, threshold: int = THRESHOLD, max_words: int = MAX_WORDS) -> DataFrame:
    """lang, words (an array; empty for all words) and count of every phrase that reaches the threshold."""
    levels, bits = [], None
    for n in range(1, max_words + 1):
        levels.append(stored(_count(docs, n, threshold, bits), f"phrases{n}"))
        bits = _filter(levels[-1], n) if n < max_words else None
        if bits is None:
            break
    rows = levels[0]
    for more in levels[1:]:
        rows = rows.unionByName(more)
    return rows.select("lang", F.when(F.col("phrase") == "", F.array().cast("array<string>")).otherwise(F.split("phrase", " ", -1)).alias("words"), "f")


# ----------------------------------------------------------- streams ----
WALKED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("a", T.LongType()), T.StructField("n", T.LongType()),
                       T.StructField("parts", T.ArrayType(T.LongType())), T.StructField("contained", T.BooleanType())])


def _walk(grams: DataFrame, backward: bool) -> DataFrame:
    """Down the stream of all phrases, in order of their words (``backward``: from the last): each phrase of two words
    or more with its count, the count of all words and the counts of its proper beginnings (``backward``: endings), the
    shortest first; and, with ``contained``, each phrase of two words or more that a one-word extension equals in count."""
    spark = grams.sparkSession
    order = grams.select("lang", (F.reverse("words") if backward else F.col("words")).alias("words"), "f")
    ranged = stored(order.repartitionByRange(tasks(spark), "lang", "words").withColumn("_range", F.spark_partition_id()), "stream")
    # what comes before a range and begins its first phrase: at most five counts a range
    first = ranged.groupBy("_range").agg(F.min(F.struct("lang", "words")).alias("head"))
    before = first.select("_range", F.col("head.lang").alias("lang"),
                          F.explode(F.expr("transform(sequence(0, size(head.words)), k -> slice(head.words, 1, k))")).alias("words"), F.size("head.words").alias("size"))
    before = before.where(F.size("words") < F.col("size")).join(order, ["lang", "words"])
    carried: dict[int, list] = {}
    for r in sorted(before.select("_range", "words", "f").collect(), key=lambda r: len(r["words"])):
        carried.setdefault(r["_range"], []).append((r["words"][-1] if r["words"] else None, r["f"]))

    def run(batches):
        now = None  # the range and language of the stack
        stack: list = []  # (word, count) from the empty phrase down
        said: list = []  # whether the phrase on the stack was already found contained
        for b in batches:
            out = []
            join = lambda ws: " ".join(reversed(ws) if backward else ws)
            for which, lang, words, f in zip(*[b.column(i).to_pylist() for i in range(4)]):
                if now is None or now[0] != which:
                    stack = list(carried.get(which, []))
                    said = [False] * len(stack)
                elif now[1] != lang:
                    stack, said = [], []
                now = (which, lang)
                depth = 0
                while depth < min(len(words), len(stack) - 1) and stack[depth + 1][0] == words[depth]:
                    depth += 1
                del stack[depth + 1:], said[depth + 1:]
                n = len(words)
                if n >= 2:
                    out.append((lang, join(words), f, stack[0][1], [s[1] for s in stack[1:n]], False))
                if n >= 3 and f >= stack[n - 1][1] and not said[n - 1]:
                    said[n - 1] = True
                    out.append((lang, join(words[:-1]), None, None, None, True))
                stack.append((words[-1] if n else None, f))
                said.append(False)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_()))], names=WALKED.names)

    runs = ranged.repartition(tasks(spark), "_range").sortWithinPartitions("_range", "lang", "words")
    return runs.select("_range", "lang", "words", "f").mapInArrow(run, WALKED)


def score(rows: DataFrame) -> DataFrame:
    """``rows`` (a, n, lefts, rights: counts of the proper beginnings and endings, the shortest first) with the cut that
    scores least, the shortest beginning on ties: score, l and r."""
    cut = F.expr("""array_min(transform(sequence(1, size(lefts)), k -> struct(
        (cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(n as decimal(15,0)))
            div (cast(lefts[k - 1] as decimal(19,0)) * cast(rights[size(rights) - k] as decimal(19,0))) as score,
        k, lefts[k - 1] as l, rights[size(rights) - k] as r)))""")
    return rows.withColumn("_cut", cut).select("*", "_cut.score", "_cut.l", "_cut.r").drop("_cut")


def collocations(docs: DataFrame, threshold: int = THRESHOLD, max_words: int = MAX_WORDS) -> DataFrame:
    """lang, phrase, a, l, r, n and score of every phrase of two words or more that reaches the threshold and lies in no
    longer one of the same count."""
    grams = frequent(docs, threshold, max_words)
    walked = (_walk(grams, False).withColumn("rights", F.lit(None).cast("array<bigint>")).withColumnRenamed("parts", "lefts")
              .unionByName(_walk(grams, True).withColumn("lefts", F.lit(None).cast("array<bigint>")).withColumnRenamed("parts", "rights")))
    whole = walked.groupBy("lang", "phrase").agg(*[F.max(c).alias(c) for c in ("a", "n", "lefts", "rights", "contained")])
    return score(whole.where(~F.col("contained"))).select("lang", "phrase", "a", "l", "r", "n", "score")


def top(docs: DataFrame, k: int = TOP, threshold: int = THRESHOLD, max_words: int = MAX_WORDS) -> DataFrame:
    """The first k collocations of each language by score and count (descending) and phrase, with their rank from 1."""
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = collocations(docs, threshold, max_words).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
