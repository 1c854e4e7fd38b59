r"""Substring dedup with repeated-phrase automata (op3).

Every word that lies in a window of ``WINDOW`` words which also starts somewhere else is removed, whole texts, exactly.

1. Phrases. Of each window the phrase of ``PHRASE`` words with the least hash is noted; equal windows note equal phrases.
   A phrase recurs if two texts, or two places of one text, note it. About one phrase in a dozen words is noted.
2. Automata. Recurring phrases are dealt into shards by the text that owns them (the least text hash), and each shard is
   compiled with pyahocorasick over numbers of words, each spelled in ``PARTS`` symbols, so that no node has a child for
   every word. Texts are streamed through the shards that hold one of their phrases, not through all: a shard with many
   texts (a hot passage) is salted into groups of bounded size.
3. Exact check. The automaton's hits give every place where a recurring phrase stands; the windows that note it are
   counted by 64-bit hash. A window notes one phrase, and a phrase has one owner, so each place of a window is counted in
   one shard only. Counts are final within a shard of one group; in salted shards, windows met once are counted across
   groups.

Texts are told apart by their 64-bit hash. Exact copies are streamed once: all their words are covered, if they have a
window. Words are `[^\x20\x09-\x0D]+`, compared unchanged.

Cases: null or wordless texts have no windows and keep nothing of nothing (the digest of the empty string); texts of
fewer than ``WINDOW`` words are left alone; repeated rows are copies of one another; an empty table gives no rows; rows
may repeat or lack ids; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, stored
from .words import NOT_SPACE, inside_text, ngram_hashes, split_words, splitmix, text_chunks

WINDOW = 35
PHRASE = 12
#: phrases in a shard (an automaton has PHRASE nodes for each at most), and bytes of texts in a group, about
SHARD_PHRASES = 50_000
GROUP_BYTES = 16 << 20
#: symbols of a word in an automaton; its nodes (PARTS times as many) search their children from first to last
PARTS = 3

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def window_hashes(h: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """Hashes of the n words from each of the places ``at`` on."""
    if not len(at):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up = np.full(len(h), _ODD)
        up[0] = 1
        up = np.cumprod(up)
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up, out=total[1:])
        down = np.full(len(h), _BACK)
        down[0] = 1
        return splitmix((total[at + n] - total[at]) * np.cumprod(down)[at])


def _least(grams: np.ndarray) -> np.ndarray:
    """Of the window at each place, the place of the phrase it notes."""
    at, least, width = np.arange(len(grams)), grams, 1
    while width < WINDOW - PHRASE + 1:  # the least of twice as many, the first of equals
        step = min(width, WINDOW - PHRASE + 1 - width)
        first = least[:-step] <= least[step:]
        at, least = np.where(first, at[:-step], at[step:]), np.where(first, least[:-step], least[step:])
        width += step
    return at


def _noted(h: np.ndarray, first: np.ndarray):
    """Places of the phrases that windows note, and the hash of every phrase."""
    grams = ngram_hashes(h, PHRASE)
    if len(h) < WINDOW:
        return np.zeros(0, np.int64), grams
    return np.unique(_least(grams)[inside_text(first, WINDOW, len(h))]), grams


def _digest(words, keep=None) -> str:
    """SHA-256 of the (kept) words of one text, joined by a space."""
    buf, starts, ends = words
    if keep is not None:
        starts, ends = starts[keep], ends[keep]
    return hashlib.sha256(b" ".join([buf[a:b] for a, b in zip(starts.tolist(), ends.tolist())])).hexdigest()


TEXTS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("whole", T.StringType()),
                      T.StructField("phrases", T.ArrayType(T.LongType())), T.StructField("twice", T.ArrayType(T.LongType()))])


def _note(column: pa.Array) -> list:
    counts, whole, sizes, flat, sizes2, flat2 = [], [], [], [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)]
    for lo, hi, buf, offs in text_chunks(column):
        w = split_words(buf, offs, NOT_SPACE)
        at, grams = _noted(w.hashes(), w.first)
        doc, value = np.searchsorted(w.first, at, side="right") - 1, grams[at]
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        begin = np.flatnonzero(new)
        many = begin[np.diff(np.append(begin, len(doc))) > 1]
        data = buf.tobytes()
        counts.append(w.counts)
        whole += [_digest((data, w.starts[a:b], w.ends[a:b])) for a, b in zip(w.first[:-1], w.first[1:])]
        for where, s, f in ((begin, sizes, flat), (many, sizes2, flat2)):
            s.append(np.bincount(doc[where], minlength=hi - lo))
            f.append(value[where].view(np.int64))
    def lists(s, f):
        ends = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *s]))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(f), pa.int64()))
    return [pa.array(np.concatenate([np.zeros(0, np.int64), *counts]), pa.int64()), pa.array(whole, pa.string()), lists(sizes, flat), lists(sizes2, flat2)]


def _word_numbers(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(0x7FFFFFFF)).astype(np.int64)


def _own_phrases(batches):
    """Of texts with the hashes of the phrases they own: (shard, the phrase's word numbers, its hash)."""
    for b in batches:
        shard, seqs, hashes = [], [], []
        own, home = b.column(1), b.column(2)
        for lo, hi, buf, offs in text_chunks(b.column(0)):
            w = split_words(buf, offs, NOT_SPACE)
            h = w.hashes()
            numbers = _word_numbers(h).astype(np.int32)
            grams = ngram_hashes(h, PHRASE)
            for d in range(hi - lo):
                wanted = np.array(own[lo + d].as_py(), np.int64).view(np.uint64)
                mine = grams[w.first[d]:max(w.first[d + 1] - PHRASE + 1, w.first[d])]
                values, at = np.unique(mine, return_index=True)
                for p in at[np.isin(values, wanted)].tolist():
                    p += int(w.first[d])
                    shard.append(home[lo + d].as_py())
                    seqs.append(numbers[p:p + PHRASE].tobytes())
                    hashes.append(int(grams[p].view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(seqs, pa.binary()), pa.array(hashes, pa.int64())], names=["shard", "seq", "phrase"])


def _automaton(phrases):
    """The phrases compiled, and the function from word numbers to the symbols to stream. Each place in a word has
    symbols of its own, so a phrase is found at the beginning of a word only."""
    seqs = np.frombuffer(b"".join(phrases), np.int32).reshape(-1, PHRASE)
    known, word = np.unique(seqs, return_inverse=True)
    base = 2
    while base ** PARTS <= len(known):
        base += 1
    place = np.arange(PARTS)
    spelled = np.arange(len(known) + 1)[:, None] // base ** place[::-1] % base + base * place  # the last: of no phrase
    a = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for p in spelled[word.reshape(seqs.shape)].reshape(len(seqs), -1):
        a.add_word(tuple(p.tolist()), 1)
    a.make_automaton()

    def symbols(numbers: np.ndarray) -> tuple:
        at = np.minimum(np.searchsorted(known, numbers), len(known) - 1)
        return tuple(spelled[np.where(known[at] == numbers, at, len(known))].reshape(-1).tolist())

    return a, symbols


def _spans(starts: np.ndarray) -> np.ndarray:
    """Sorted distinct window starts -> (begin, end) of the runs of words they cover, flat."""
    cut = np.flatnonzero(np.diff(starts) > WINDOW) + 1
    return np.stack([starts[np.append(0, cut)], starts[np.append(cut - 1, len(starts) - 1)] + WINDOW], axis=1).reshape(-1)


FOUND = "text_hash long, spans binary, windows array<long>, at array<int>"


def _locate(phrases: pa.Table, texts: pa.Table) -> pa.Table:
    """One group: the spans of windows met more than once, and, in a salted shard, the windows met once and (without a
    text) the ones already settled."""
    found = {"text_hash": [], "spans": [], "windows": [], "at": []}
    hashes, first_of = np.unique(texts.column("text_hash").to_numpy(), return_index=True)
    seen, text, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if phrases.num_rows and texts.num_rows:
        automaton, symbols = _automaton(sorted(set(phrases.column("seq").to_pylist())))
        mine = phrases.column("phrase").to_numpy().view(np.uint64)
        column = texts.column("text").combine_chunks().take(pa.array(first_of))
        for lo, hi, buf, offs in text_chunks(column):
            w = split_words(buf, offs, NOT_SPACE)
            h = w.hashes()
            if len(h) < WINDOW:
                continue
            end = np.array([e for e, _ in automaton.iter(symbols(_word_numbers(h)))], np.int64)
            begin = end // PARTS - (PHRASE - 1)
            grams = ngram_hashes(h, PHRASE)
            hit = np.zeros(len(grams), bool)
            hit[begin[np.isin(grams[begin], mine)]] = True  # word numbers are shorter than hashes
            at = np.flatnonzero(hit[_least(grams)] & inside_text(w.first, WINDOW, len(h)))
            d = np.searchsorted(w.first, at, side="right") - 1
            seen.append(window_hashes(h, WINDOW, at))
            text.append(lo + d)
            place.append(at - w.first[d])
    seen, text, place = np.concatenate(seen), np.concatenate(text), np.concatenate(place)
    _, inverse, count = np.unique(seen, return_inverse=True, return_counts=True)
    more = count[inverse] > 1
    salted = texts.num_rows > 0 and texts.column("salts")[0].as_py() > 1

    def runs(mask):
        idx = np.flatnonzero(mask)
        cut = np.flatnonzero(np.diff(text[idx])) + 1
        return [x for x in np.split(idx, cut) if len(x)]

    def add(t, spans, windows, at):
        for k, v in zip(found, (t, spans, windows, at)):
            found[k].append(v)

    for x in runs(more):
        add(int(hashes[text[x[0]]]), _spans(place[x]).astype(np.int64).tobytes(), None, None)
    if salted:
        for x in runs(~more):
            add(int(hashes[text[x[0]]]), None, seen[x].view(np.int64), place[x].astype(np.int32))
        if more.any():
            add(None, None, np.unique(seen[more]).view(np.int64), None)
    return pa.Table.from_arrays([pa.array(found["text_hash"], pa.int64()), pa.array(found["spans"], pa.binary()), pa.array(found["windows"], pa.list_(pa.int64())),
                                 pa.array(found["at"], pa.list_(pa.int32()))], names=list(found))


def _without(column: pa.Array, spans, starts) -> list:
    removed, kept = [], []
    for lo, hi, buf, offs in text_chunks(column):
        w = split_words(buf, offs, NOT_SPACE)
        data = buf.tobytes()
        for d in range(hi - lo):
            a, b = w.first[d], w.first[d + 1]
            cover = np.zeros(b - a + 1, np.int64)
            for s in spans[lo + d].as_py() or []:
                x = np.frombuffer(s, np.int64)
                np.add.at(cover, x[::2], 1)
                np.add.at(cover, x[1::2], -1)
            single = np.array(starts[lo + d].as_py() or [], np.int64)
            np.add.at(cover, single, 1)
            np.add.at(cover, single + WINDOW, -1)
            gone = np.cumsum(cover[:-1]) > 0
            removed.append(int(gone.sum()))
            kept.append(_digest((data, w.starts[a:b], w.ends[a:b]), ~gone))
    return [pa.array(removed, pa.int64()), pa.array(kept, pa.string())]


def _remove(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), *_without(b.column(1), b.column(2), b.column(3))], names=["text_hash", "n_removed", "kept"])


def drop_repeats(docs: DataFrame, shard_phrases: int = SHARD_PHRASES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    docs = docs.select("doc_id", "text")
    noted = annotate(docs, "text", TEXTS, lambda: _note)
    texts = stored(noted.select("doc_id", F.xxhash64("text").alias("text_hash"), "n_words", "whole", "phrases", "twice"), "texts")
    # 1. recurring phrases and their owners
    each = texts.select("text_hash", F.explode("phrases").alias("phrase"))
    inner = texts.select("text_hash", F.explode("twice").alias("phrase"), F.lit(1).alias("again"))
    recurring = (each.withColumn("again", F.lit(0)).unionAll(inner).groupBy("phrase")
                 .agg(F.min("text_hash").alias("owner"), F.max("text_hash").alias("other"), F.max("again").alias("again"))
                 .where("owner <> other OR again = 1").select("phrase", "owner"))
    recurring = stored(recurring, "phrases")
    shards = max(1, math.ceil(recurring.count() / shard_phrases))
    shard_of = lambda c: F.pmod(F.xxhash64(c), F.lit(shards))
    # 2. the texts of each shard: of each distinct text one row
    routes = (each.join(recurring, "phrase").groupBy("text_hash")
              .agg(F.collect_set(shard_of("owner")).alias("shards"), F.collect_set(F.when(F.col("owner") == F.col("text_hash"), F.col("phrase"))).alias("own")))
    copies = texts.groupBy("text_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    routes = routes.join(copies.select(F.col("text_hash").alias("_c"), "rep"), F.col("text_hash") == F.col("_c")).drop("_c")
    mine = docs.withColumn("_t", F.xxhash64("text"))
    routed = stored(mine.join(routes, (F.col("_t") == F.col("text_hash")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("text_hash", "text", "shards", "own"), "routed")
    own = routed.where("size(own) > 0").select("text", "own", shard_of("text_hash").alias("home")).mapInArrow(_own_phrases, "shard long, seq binary, phrase long")
    dealt = routed.select("text_hash", "text", F.explode("shards").alias("shard"))
    salts = (routed.select(F.explode("shards").alias("shard"), F.octet_length("text").alias("b")).groupBy("shard")
             .agg(F.ceil(F.sum("b") / group_bytes).cast("int").alias("salts")).where("salts > 0"))
    salts = stored(salts, "salts")
    dealt = dealt.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("text_hash", F.lit(7)), F.col("salts")).cast("int"))
    own = own.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("shard", "salt", "seq", "phrase")
    found = stored(own.groupBy("shard", "salt").cogroup(dealt.groupBy("shard", "salt")).applyInArrow(_locate, FOUND), "found")
    # 3. windows of salted shards, across groups
    single = found.where("windows IS NOT NULL AND text_hash IS NOT NULL").select("text_hash", F.explode(F.arrays_zip("windows", "at")).alias("x"))
    single = single.select("text_hash", F.col("x.windows").alias("window"), F.col("x.at").alias("at"))
    settled = found.where("text_hash IS NULL").select(F.explode("windows").alias("window"), F.lit(2).alias("n"))
    again = single.select("window", F.lit(1).alias("n")).unionAll(settled).groupBy("window").agg(F.sum("n").alias("n")).where("n > 1").select("window")
    starts = single.join(again, "window").select("text_hash", F.lit(None).cast("binary").alias("spans"), "at")
    cover = (found.where("spans IS NOT NULL").select("text_hash", "spans", F.lit(None).cast("int").alias("at")).unionAll(starts)
             .groupBy("text_hash").agg(F.collect_list("spans").alias("spans"), F.collect_list("at").alias("starts")))
    cut = (routed.select("text_hash", "text").join(cover, "text_hash").select("text_hash", "text", "spans", "starts")
           .mapInArrow(_remove, "text_hash long, n_removed long, kept string").dropDuplicates(["text_hash"]))
    rows = texts.select("doc_id", "text_hash", "n_words", "whole").join(copies.select("text_hash", "copies"), "text_hash").join(cut, "text_hash", "left")
    copied = (F.col("copies") > 1) & (F.col("n_words") >= WINDOW)
    return rows.select("doc_id", "n_words", F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                       F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"))
