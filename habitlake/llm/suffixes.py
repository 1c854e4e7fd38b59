"""Benchmark decontamination with training suffix arrays (op4).

Benchmark items are a stated query set, taken in blocks of bounded size. Each task builds suffix arrays over its
documents' words, one per shard of bounded length, and binary-searches the item suffixes in them, word by word: the
range that is left after ``WINDOW`` words holds all places of that window, and from each place the match is followed on
to its full verbatim length: the other way round, in a suffix array of the block's items, whose range for the window is
narrowed word by word, so that the longest match of any item is found. Suffixes that begin with the same window are
searched once. Words that no item of the
block has cannot be part of a match, so they end stretches, and stretches shorter than the shortest window are left out
of the array.

Cases: null or wordless texts have no words, are never hit and contaminate nothing; an item without an id hits words
but is not listed or counted; items that repeat an id count once; rows that repeat a document are judged each by itself;
an empty benchmark hits nothing; of a document's equally long longest matches the first is reported, and of the items
that hold it from a window's place on the one with the least id as a string (without an id last).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, stored
from .words import ALNUM, LOWER, split_words, text_chunks

WINDOW = 13
#: a document is contaminated if at least one of so many of its words is hit
SHARE = 20
#: bytes of benchmark text in a block, and of documents in a shard, at most (or one text)
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20


@dataclass
class Block:
    """Items of one block: their vocabulary, their words as numbers from 1, and their distinct windows."""

    vocabulary: np.ndarray  # sorted word hashes; number of a word = its index + 1
    words: np.ndarray       # all items one after another, 0 after each
    starts: np.ndarray      # where the suffix begins that stands for each distinct window
    width: np.ndarray       # length of the window
    items: list             # ids of the items that have the window
    array: np.ndarray       # the suffixes that begin with a window, sorted
    ranges: np.ndarray      # where each distinct window's suffixes lie in the array
    owner: np.ndarray       # place in names of the item of each suffix in the array
    names: list             # sorted ids, None at the end


def block_of(rows) -> Block:
    """Rows are (item_id, text)."""
    column = pa.array([r[1] for r in rows], pa.string())
    ids = [None if r[0] is None else str(r[0]) for r in rows]
    hashes, lengths = [np.zeros(0, np.uint64)], []
    for _, _, buf, offs in text_chunks(column):
        w = split_words(LOWER[buf], offs, ALNUM)
        hashes.append(w.hashes())
        lengths += w.counts.tolist()
    flat = np.concatenate(hashes)
    vocabulary = np.unique(flat)
    number = np.searchsorted(vocabulary, flat) + 1
    words, windows = [np.zeros(0, np.int64)], {}
    starts, width, items, every, owner = [], [], [], [], []
    names = sorted({x for x in ids if x is not None}) + [None]
    place = {x: i for i, x in enumerate(names)}
    at = base = 0
    for k, length in enumerate(lengths):
        seq = number[at:at + length]
        words += [seq, np.zeros(1, np.int64)]
        size = min(WINDOW, length)
        for s in range(length - size + 1 if length else 0):
            w = windows.setdefault(seq[s:s + size].tobytes(), len(starts))
            if w == len(starts):
                starts.append(base + s)
                width.append(size)
                items.append(set())
            every.append(base + s)
            owner.append(place[ids[k]])
            if ids[k] is not None:
                items[w].add(ids[k])
        at += length
        base += length + 1
    words, every = np.concatenate(words), np.array(every, np.int64)
    of = np.full(len(words), -1, np.int64)
    of[every] = owner
    array = suffix_array(words, np.flatnonzero(words), max(lengths, default=1))
    array = array[of[array] >= 0]
    block = Block(vocabulary, words, np.array(starts, np.int64), np.array(width, np.int64), items, array, np.zeros((0, 2), np.int64), of[array], names)
    block.ranges = search(words, array, block)
    return block


def suffix_array(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of the suffixes of ``text`` (0 ends a suffix), compared on ``depth`` words at least, by
    doubling ranks."""
    rank = np.concatenate([text, np.zeros(1, text.dtype)]).astype(np.int64)
    order = starts[np.argsort(rank[starts], kind="stable")]
    k = 1
    while k < depth and len(starts):
        key = np.zeros_like(rank)
        ahead = np.minimum(starts + k, len(text))
        key[starts] = rank[starts] * (rank.max() + 1) + rank[ahead]
        order = starts[np.argsort(key[starts], kind="stable")]
        fresh = np.ones(len(order), np.int64)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        ranked = np.zeros_like(rank)
        ranked[order] = np.cumsum(fresh)
        rank = ranked
        if fresh.all():
            break
        k *= 2
    return order


def _narrow(column, lo, hi, wanted, right):
    """For each range [lo, hi) of the sorted ``column(i)``: where ``wanted`` begins (or ends, if right)."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        value = column(np.where(open_, mid, 0))
        below = (value <= wanted) if right else (value < wanted)
        lo = np.where(open_ & below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)


def search(text: np.ndarray, array: np.ndarray, block: Block):
    """The range in the suffix array of each window of the block, by a binary search per word of depth."""
    padded = np.append(text, 0)
    live = np.arange(len(block.starts))
    lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(array), np.int64)
    spans = np.zeros((len(live), 2), np.int64)
    depth = 0
    while len(live):
        wanted = block.words[block.starts[live] + depth]
        column = lambda i, d=depth: padded[np.minimum(array[i] + d, len(text))]
        lo = _narrow(column, lo, hi, wanted, False)
        hi = _narrow(column, lo, hi, wanted, True)
        depth += 1
        done = block.width[live] == depth
        spans[live[done]] = np.stack([lo[done], hi[done]], axis=1)
        on = (lo < hi) & ~done
        live, lo, hi = live[on], lo[on], hi[on]
    return spans


def shard_hits(words, block: Block):
    """Of a shard's words (``Words``): for each document the places of its hit words, the ids of the items hit, and its
    longest verbatim match as (words, item id, first word)."""
    n = len(words.first) - 1
    h = words.hashes()
    at = np.searchsorted(block.vocabulary, h)
    known = at < len(block.vocabulary)
    known[known] = block.vocabulary[at[known]] == h[known]
    # a 0 after each document; documents keep their order
    doc = words.docs()
    place_of = np.arange(len(h)) + doc
    text = np.zeros(len(h) + n, np.int64)
    text[place_of[known]] = at[known] + 1
    least = int(block.width.min(initial=WINDOW))
    inside = text > 0
    cut = np.flatnonzero(~inside)
    ends = np.append(cut, len(text))
    after = ends[np.searchsorted(ends, np.arange(len(text)))] if len(text) else ends[:0]  # end of the stretch from here
    before = np.concatenate([[-1], cut])
    begin = before[np.searchsorted(cut, np.arange(len(text)))] + 1 if len(text) else before[:0]
    starts = np.flatnonzero(inside & (after - begin >= least))
    array = suffix_array(text, starts, int(block.width.max(initial=1)))
    spans = search(text, array, block)
    window = np.repeat(np.arange(len(spans)), spans[:, 1] - spans[:, 0])
    found = np.concatenate([np.zeros(0, np.int64), *(array[a:b] for a, b in spans[spans[:, 1] > spans[:, 0]])])
    cover = np.zeros(len(text) + 1, np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + block.width[window], -1)
    hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    first = words.first + np.arange(n + 1)  # of each document, in text
    owner = np.searchsorted(first, hit, side="right") - 1
    places = {int(d): hit[a:b] - first[d] for d, a, b in _runs(owner)}
    length, begin, end = _followed(np.append(text, 0), found, block, window)
    of = np.searchsorted(first, found, side="right") - 1
    order = np.lexsort((found, -length, of))
    items, best = {}, {}
    for d, a, b in _runs(of[order]):
        top = order[a]
        best[int(d)] = (int(length[top]), block.names[block.owner[begin[top]:end[top]].min()], int(found[top] - first[d]))
        items[int(d)] = set().union(*(block.items[w] for w in np.unique(window[order[a:b]])))
    return places, items, best


def _runs(sorted_: np.ndarray):
    """(value, begin, end) of each run of equal values."""
    value, begin = np.unique(sorted_, return_index=True)
    return zip(value, begin, np.append(begin[1:], len(sorted_)))


def _followed(text: np.ndarray, found: np.ndarray, block: Block, window: np.ndarray):
    """The full verbatim length of the match at each place found, and the range of the block's suffixes that have it."""
    length, lo, hi = block.width[window].copy(), block.ranges[window, 0], block.ranges[window, 1]
    live = np.arange(len(found))
    while len(live):
        wanted = text[np.minimum(found[live] + length[live], len(text) - 1)]
        column = lambda i, at=length[live]: block.words[np.minimum(block.array[i] + at, len(block.words) - 1)]
        begin = _narrow(column, lo[live], hi[live], wanted, False)
        end = _narrow(column, begin, hi[live], wanted, True)
        on = (begin < end) & (wanted > 0)
        live = live[on]
        lo[live], hi[live] = begin[on], end[on]
        length[live] += 1
    return length, lo, hi


FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("_hits", T.BinaryType()), T.StructField("_items", T.ArrayType(T.StringType())),
                      T.StructField("_match", T.StructType([T.StructField("words", T.LongType()), T.StructField("item_id", T.StringType()), T.StructField("first_word", T.LongType())]))])
_MATCH = pa.struct([("words", pa.int64()), ("item_id", pa.string()), ("first_word", pa.int64())])


def _finder(shared):
    def make():
        block = shared.value

        def run(column: pa.Array) -> list:
            n = len(column)
            counts = np.zeros(n, np.int64)
            hits, items, match = [None] * n, [None] * n, [None] * n
            for lo, hi, buf, offs in text_chunks(column, SHARD_BYTES):
                words = split_words(LOWER[buf], offs, ALNUM)
                counts[lo:hi] = words.counts
                places, named, best = shard_hits(words, block)
                for d, p in places.items():
                    hits[lo + d] = p.astype(np.int64).tobytes()
                for d, x in named.items():
                    items[lo + d] = sorted(x)
                for d, m in best.items():
                    match[lo + d] = dict(zip(("words", "item_id", "first_word"), m))
            return [pa.array(counts), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(match, _MATCH)]
        return run
    return make




def find_contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (_row: the original row; n_words, n_hit, items, longest match, contaminated), without any shuffle of texts.

    One pass over the documents for each block of the benchmark: the places hit and the items of all blocks are united
    per row."""
    spark = docs.sparkSession
    bench = benchmark.select("item_id", "text").where("text IS NOT NULL").distinct()
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    for b in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else bench
        shared = spark.sparkContext.broadcast(block_of([tuple(r) for r in part.collect()]))  # about block_bytes of text
        now = annotate(df, "_text", FOUND, _finder(shared))
        if b:
            now = now.select("_row", "_text", "n_words", F.array_append("_all", F.col("_hits")).alias("_all"),
                             F.array_union("_names", F.coalesce("_items", F.array().cast("array<string>"))).alias("_names"),
                             _better().alias("_best"))
        else:
            now = now.select("_row", "_text", "n_words", F.array("_hits").alias("_all"), F.coalesce("_items", F.array().cast("array<string>")).alias("_names"), F.col("_match").alias("_best"))
        df = now if blocks == 1 else stored(now, f"block{b}")
        if b < blocks - 1:
            df = df.drop("n_words")
    counted = _united(df) if blocks > 1 else df.withColumn("n_hit", F.coalesce(F.octet_length(F.col("_all")[0]) / 8, F.lit(0)).cast("long"))
    return counted.select("_row", "n_words", "n_hit", F.array_sort("_names").alias("items"), F.col("_best").alias("longest_match"),
                          ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def _better():
    """The longer match of ``_match`` and ``_best``; of equally long ones the earlier, then that of the least id."""
    ranked = lambda c: F.struct(-F.col(f"{c}.words"), F.col(f"{c}.first_word"), F.col(f"{c}.item_id").isNull(), F.col(f"{c}.item_id"))
    return F.when(F.col("_best").isNull() | (F.col("_match").isNotNull() & (ranked("_match") < ranked("_best"))), F.col("_match")).otherwise(F.col("_best"))


def _united(df: DataFrame) -> DataFrame:
    """n_hit where several blocks have found places: the distinct ones."""
    schema = T.StructType(df.schema.fields + [T.StructField("n_hit", T.LongType())])
    at = df.columns.index("_all")

    def run(batches):
        for b in batches:
            n = [len(np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in row if x] or [np.zeros(0, np.int64)]))) for row in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=schema.names)

    return df.mapInArrow(run, schema)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    return found.select(F.col("_row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
                        F.col("longest_match.words").alias("longest_words"), F.col("longest_match.item_id").alias("longest_item"), F.col("longest_match.first_word").alias("longest_at"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged."""
    return find_contamination(docs, benchmark).where("NOT contaminated").select("_row.*")
