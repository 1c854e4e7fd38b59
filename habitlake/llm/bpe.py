"""Exact BPE encoding and decoding by speculation and verification (op13).

The vocabulary is a public ``tokenizers`` file, given as a path: a BPE model with an end-of-word mark whose normalizer
and splitting drop white space. Added tokens are cut out first, in the raw text; the file's own normalizer and splitter
make the pieces. White space never joins what it parts under either, so both run once for each distinct raw word.

* Speculate: the longest token at every place of the distinct pieces, by one walk down a trie of all places at once;
  the greedy proposal jumps from token to token.
* Verify: a row of tokens is what merging gives if and only if each token is what merging gives for itself and each
  adjacent pair is what merging gives for the two. Merges are undone from the latest back on both sides of the boundary;
  the pair fails if a merge across it would have come before the one undone. All distinct pairs are walked at once.
* Only pieces with a failing pair are merged exactly, with a heap.

This needs a vocabulary in which each merged token has one merge, later than those of its parts; ``load`` raises
``ValueError`` for any other. Token ids are kept as little-endian unsigned 32-bit integers in one binary value per row.

Cases: null and empty texts and texts of white space have no token and decode to the empty string; repeated rows are
encoded each by itself; other columns are ignored, whatever their names; a very long text is encoded in blocks of words
and a very long piece in blocks of places (heap merging, where it fails, is n log n); empty tables give empty tables.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate
from .words import NOT_SPACE, split_words, text_chunks

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: distinct raw words and pieces kept by a task (a piece costs more to encode), and the longest one that is kept
MEMO, PIECES, MEMO_WORD = 1 << 19, 1 << 19, 256
#: bytes of text, words and places taken at once
CHUNK, WORDS, BLOCK = 1 << 21, 1 << 18, 1 << 18
#: symbols of a piece that is merged without a heap
SHORT = 48
NEVER = np.iinfo(np.int64).max
#: raw words whose pieces are plain: ASCII letters, lower-cased, and the other signs after them (no apostrophe, which
#: may begin a piece with letters); an encoder checks that its file's own tools agree before it uses this
PLAIN = re.compile(rb"([A-Za-z]+)([!-&(-/:-@\[-`{-~]*)")


@dataclass
class Merges:
    """Tables by token id; a base symbol has rank -1. ``pairs`` are the merged pairs (left * size + right), sorted, with
    their ranks and results; ``keys`` the trie's edges (node * size + symbol), sorted, with the nodes they lead to."""

    size: int
    left: np.ndarray
    right: np.ndarray
    rank: np.ndarray
    pairs: np.ndarray
    pair_rank: np.ndarray
    pair_token: np.ndarray
    keys: np.ndarray
    nodes: np.ndarray
    node_token: np.ndarray
    depth: int

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; ``NEVER`` where there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, joined: bool = False) -> np.ndarray:
        """Whether merging the symbols of a[i] and b[i] leaves exactly these two tokens; with ``joined``, whether it
        leaves them until the last merge, which joins them."""
        x, y = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(x), -1 if joined else NEVER)
        good = np.ones(len(x), bool)
        todo = np.arange(len(x))
        while len(todo):
            p, q = x[todo], y[todo]
            crossed = self.rank_of(p, q) < limit[todo]
            good[todo[crossed]] = False
            rp, rq = self.rank[p], self.rank[q]
            on = ~crossed & (np.maximum(rp, rq) >= 0)
            todo, p, q, rp, rq = todo[on], p[on], q[on], rp[on], rq[on]
            # of one rank the left merge comes first, so the right one is undone first
            first = rp > rq
            x[todo] = np.where(first, self.right[p], p)
            y[todo] = np.where(first, q, self.left[q])
            # a merge across the boundary wins a tie against one on its right, not against one on its left
            limit[todo] = np.where(first, rp, rq + 1)
        return good


def load(path: str = VOCABULARY) -> tuple[str, Merges, list[str]]:
    """The file's text, its merge tables and the token strings by id."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    model = json.loads(text)["model"]
    if json.loads(text).get("decoder"):
        raise ValueError("only vocabularies without a decoder of their own")
    if model["type"] != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
        raise ValueError("not a plain BPE vocabulary")
    vocab = model["vocab"]
    added = {t["content"]: t["id"] for t in json.loads(text)["added_tokens"]}
    names = [""] * (max([*vocab.values(), *added.values()]) + 1)
    for t, i in [*vocab.items(), *added.items()]:
        names[i] = t
    size = len(names)
    left, right, rank = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, -1, np.int64)
    for r, merge in enumerate(model["merges"]):
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        t = vocab[a + b]
        if rank[t] >= 0 or max(rank[vocab[a]], rank[vocab[b]]) >= r:
            raise ValueError(f"{a + b!r} is merged twice or before its parts")
        left[t], right[t], rank[t] = vocab[a], vocab[b], r
    made = np.flatnonzero(rank >= 0)
    pair = left[made] * size + right[made]
    order = np.argsort(pair)
    m = Merges(size, left, right, rank, pair[order], rank[made][order], made[order], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
    whole = np.ones(size, bool)  # merging gives the token for its own symbols
    whole[made] = m.compatible(left[made], right[made], joined=True)
    for t in made[np.argsort(rank[made])]:
        whole[t] &= whole[left[t]] and whole[right[t]]
    symbols: dict[int, tuple] = {i: (i,) for i in range(size) if rank[i] < 0 and names[i] not in added}
    edges, ends = {}, [-1]
    for t in [*symbols, *made[np.argsort(rank[made])].tolist()]:
        if rank[t] >= 0:
            symbols[t] = symbols[left[t]] + symbols[right[t]]
        if whole[t]:
            node = 0
            for s in symbols[t]:
                node = edges.setdefault(node * size + s, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = t
            m.depth = max(m.depth, len(symbols[t]))
    m.keys = np.sort(np.fromiter(edges, np.int64, len(edges)))
    m.nodes = np.array([edges[k] for k in m.keys.tolist()], np.int64)
    m.node_token = np.array(ends, np.int64)
    return text, m, names


def longest(m: Merges, sym: np.ndarray, ends: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest token from each place lo..hi-1 of ``sym`` on, within the piece that ends at ``ends``, and its length."""
    place, last = np.arange(lo, hi), ends[lo:hi]
    token, length = np.full(hi - lo, -1), np.zeros(hi - lo, np.int64)
    live, node = np.arange(hi - lo), np.zeros(hi - lo, np.int64)
    for d in range(m.depth):
        on = place[live] + d < last[live]
        live, node = live[on], node[on]
        if not len(live):
            break
        key = node * m.size + sym[place[live] + d]
        at = np.minimum(np.searchsorted(m.keys, key), len(m.keys) - 1)
        hit = m.keys[at] == key
        live, node = live[hit], m.nodes[at[hit]]
        end = m.node_token[node]
        some = end >= 0
        token[live[some]], length[live[some]] = end[some], d + 1
    return token, length


def merge_exactly(rank: dict, token: dict, sym: list[int]) -> list[int]:
    """Plain merging: the pair of least rank, leftmost first, until none is left."""
    n = len(sym)
    if n <= SHORT:  # looking through all pairs costs less than a heap
        sym, get = list(sym), rank.get
        ranks = [get(p, NEVER) for p in zip(sym, sym[1:])]
        while ranks and (least := min(ranks)) < NEVER:
            i = ranks.index(least)
            sym[i] = token[sym[i], sym[i + 1]]
            del sym[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((sym[i - 1], sym[i]), NEVER)
            if i < len(ranks):
                ranks[i] = get((sym[i], sym[i + 1]), NEVER)
        return sym
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = list(sym)
    heap = [(rank[p], i, p) for i, p in enumerate(zip(sym, sym[1:])) if p in rank]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if alive[i] != pair[0] or j >= n or alive[j] != pair[1]:
            continue
        alive[i], alive[j] = token[pair], -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            p = (alive[i], alive[after[i]])
            if p in rank:
                heapq.heappush(heap, (rank[p], i, p))
        if before[i] >= 0:
            p = (alive[before[i]], alive[i])
            if p in rank:
                heapq.heappush(heap, (rank[p], before[i], p))
    return [t for t in alive if t >= 0]


class Encoder:
    """Encodes raw words (without white space); one per task."""

    def __init__(self, text: str, merges: Merges):
        from tokenizers import Tokenizer
        self.tool, self.m = Tokenizer.from_str(text), merges
        spec = json.loads(text)
        vocab, mark = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be plain strings of the raw text")
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.inner = {t: i for t, i in vocab.items() if len(t) == 1}
        self.final = {t[:-len(mark)]: i for t, i in vocab.items() if len(t) == 1 + len(mark) and t.endswith(mark)} if mark else self.inner
        pairs = [divmod(k, merges.size) for k in merges.pairs.tolist()]
        self.rank, self.token = dict(zip(pairs, merges.pair_rank.tolist())), dict(zip(pairs, merges.pair_token.tolist()))
        letters = string.ascii_letters
        signs = [chr(c) for c in range(33, 127) if chr(c) != "'" and not chr(c).isalnum()]
        self.plain = all(self.cut_by_tool(letters + s + t) == [letters.lower(), s + t] for s in signs for t in signs) and self.cut_by_tool(letters) == [letters.lower()]
        self.fixed = {i.to_bytes(4, "little"): i.to_bytes(4, "little") for i in self.added.values()}
        self.known: dict = dict(self.fixed)  # packed ids of pieces
        self.failed = self.seen = 0

    def parts(self, raw: bytes) -> list:
        """Pieces (strings) and packed ids of added tokens of a raw word, in order."""
        simple = self.plain and PLAIN.fullmatch(raw)
        if simple:
            letters, signs = simple.groups()
            return [letters.decode().lower(), signs.decode()] if signs else [letters.decode().lower()]
        return self.cut_by_tool(raw.decode("utf-8"))

    def cut_by_tool(self, raw: str) -> list:
        """The same by the file's own normalizer and splitter."""
        out = []
        for seg in self.cut.split(raw) if self.cut else [raw]:
            if seg in self.added:
                out.append(self.added[seg].to_bytes(4, "little"))
            elif seg:
                out += [p for p, _ in self.tool.pre_tokenizer.pre_tokenize_str(self.tool.normalizer.normalize_str(seg))]
        return out

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Packed token ids of each distinct piece."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        stop = np.cumsum(sizes)
        sym = np.fromiter(map(self.inner.__getitem__, itertools.chain.from_iterable(pieces)), np.int64, int(sizes.sum()))
        sym[stop - 1] = [self.final[p[-1]] for p in pieces]
        ends = np.repeat(stop, sizes)
        found = [longest(self.m, sym, ends, lo, min(lo + BLOCK, len(sym))) for lo in range(0, len(sym), BLOCK)]
        if not found:
            return []
        token = np.concatenate([f[0] for f in found])
        step = np.concatenate([f[1] for f in found]).tolist()
        places, first, s = [], [0], 0
        for e in stop.tolist():
            while s < e:
                places.append(s)
                s += step[s]
            first.append(len(places))
        ids = token[np.array(places, np.int64)]
        owner = np.repeat(np.arange(len(pieces)), np.diff(first))
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pair, back = np.unique(ids[inside] * self.m.size + ids[inside + 1], return_inverse=True)
        bad = inside[~self.m.compatible(pair // self.m.size, pair % self.m.size)[back]]
        flat = ids.astype("<u4").tobytes()
        out = [flat[4 * a:4 * b] for a, b in zip(first, first[1:])]
        failing = np.unique(owner[bad]).tolist()
        self.seen, self.failed = self.seen + len(pieces), self.failed + len(failing)
        begin = (stop - sizes).tolist()
        for i in failing:
            out[i] = np.array(merge_exactly(self.rank, self.token, sym[begin[i]:begin[i] + len(pieces[i])].tolist()), "<u4").tobytes()
        return out

    def words(self, raws: list[bytes]) -> list[bytes]:
        """Packed token ids of each raw word."""
        parts = list(map(self.parts, raws))
        if len(self.known) > PIECES:
            self.known = dict(self.fixed)
        known = self.known
        fresh = list({p: None for ps in parts for p in ps if p not in known})
        known.update(zip(fresh, self.pieces(fresh)))
        out = [b"".join(map(known.__getitem__, ps)) for ps in parts]
        for p in fresh:
            if len(p) > MEMO_WORD:
                del known[p]
        return out


ENCODED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
DECODED = T.StructType([T.StructField("decoded", T.StringType())])


def _encoder(shared):
    def make():
        encoder, memo = Encoder(*shared.value), {}

        def block(w, lo, hi) -> list[bytes]:
            """Packed ids of each word of a block."""
            coded = w.column(np.arange(lo, hi)).dictionary_encode()
            _, offs, data = coded.dictionary.buffers()
            offs, data = np.frombuffer(offs, np.int64)[:len(coded.dictionary) + 1].tolist(), data.to_pybytes()
            distinct = [data[a:b] for a, b in zip(offs, offs[1:])]
            if len(memo) > MEMO:
                memo.clear()
            each = list(map(memo.get, distinct))
            fresh = [i for i, p in enumerate(each) if p is None]
            for i, p in zip(fresh, encoder.words([distinct[i] for i in fresh])):
                each[i] = p
                if len(distinct[i]) <= MEMO_WORD:
                    memo[distinct[i]] = p
            return list(map(each.__getitem__, coded.indices.to_numpy().tolist()))

        def run(column: pa.Array) -> list:
            out = []
            for _, _, buf, offs in text_chunks(column, CHUNK):
                w = split_words(buf, offs, NOT_SPACE)
                texts = [[] for _ in range(len(offs) - 1)]
                owner = w.docs()
                for lo in range(0, len(w.starts), WORDS):
                    hi = min(lo + WORDS, len(w.starts))
                    packed = block(w, lo, hi)
                    a, b = owner[lo], owner[hi - 1]
                    cuts = np.clip(w.first[a:b + 2] - lo, 0, hi - lo).tolist()
                    for d in range(a, b + 1):
                        texts[d].append(b"".join(packed[cuts[d - a]:cuts[d - a + 1]]))
                out += [b"".join(t) for t in texts]
            return [pa.array([len(t) // 4 for t in out], pa.int64()), pa.array(out, pa.binary())]
        return run
    return make


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens and ids (packed little-endian unsigned 32-bit integers) of every row."""
    text, merges, _ = load(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((text, merges))  # the vocabulary
    return annotate(docs.select("doc_id", "text"), "text", ENCODED, _encoder(shared)).drop("text")


def _decoder(shared):
    def make():
        names = shared.value

        def run(column: pa.Array) -> list:
            texts = []
            for packed in column.to_pylist():
                ids = np.frombuffer(packed or b"", "<u4")
                blocks = (ids[i:i + BLOCK].tolist() for i in range(0, len(ids), BLOCK))
                texts.append(" ".join(" ".join(map(names.__getitem__, b)) for b in blocks))
            return [pa.array(texts, pa.string())]
        return run
    return make


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``encoded`` (with packed ``ids``; null counts as none) and the decoded text, in a column ``decoded``: the
    vocabulary names no decoder, so tokens are joined by spaces as they are written in it."""
    _, _, names = load(vocabulary)
    shared = encoded.sparkSession.sparkContext.broadcast(names)
    return annotate(encoded, "ids", DECODED, _decoder(shared))


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Digests of the ids and of the decoded text of every row; the ids are encoded and decoded again by one task."""
    text, merges, names = load(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((text, merges))
    words = docs.sparkSession.sparkContext.broadcast(names)

    def make():
        encoded, decoded = _encoder(shared)(), _decoder(words)()

        def run(column: pa.Array) -> list:
            n, ids = encoded(column)
            return [n, ids, *decoded(ids)]
        return run

    rows = annotate(docs.select("doc_id", "text"), "text", T.StructType([*ENCODED.fields, *DECODED.fields]), make)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
