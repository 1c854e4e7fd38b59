"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens (op10).

A text is cut into pre-tokens that cover it whole: each run of non-space bytes with the one space in front of it, and
what white space is left between, in runs. The vocabulary is a public byte-level one, given as a path; a piece of rank r
has probability proportional to 1 / (r + ``SHIFT``) (vocabularies list pieces about from frequent to rare; nothing is
trained). The count of a pre-token is the number of pieces of its likeliest segmentation, the fewest on a tie.

Distinct pre-tokens are visited as a trie in depth-first order: sorted, each one keeps the forward scores of the prefix
that it shares with the one before, and only the nodes below are computed. Terminal counts are stored per task, in a
memo that is emptied when it is full, and texts are streamed without a shuffle.

Cases: null and empty texts have 0 pre-tokens and tokens; bytes always have pieces, so any text can be counted; repeated
rows are counted each by itself; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import annotate
from .words import Words, text_chunks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SHIFT = 10
#: terminal counts kept by a task
MEMO = 1 << 20


@dataclass
class Pieces:
    score: dict  # piece -> log probability
    tails: set   # all ends of pieces


def load(path: str = VOCABULARY) -> Pieces:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    total = math.log(sum(1 / (r + SHIFT) for r in ranks.values()))
    return Pieces({p: -math.log(r + SHIFT) - total for p, r in ranks.items()}, {p[i:] for p in ranks for i in range(len(p))})


def count_sorted(words: list[bytes], pieces: Pieces) -> list[int]:
    """Number of pieces of each of the words, which are sorted."""
    score, tails = pieces.score, pieces.tails
    best, count = [0.0], [0]  # forward scores along the path from the trie's root
    before, out = b"", []
    for w in words:
        n, top = 0, min(len(w), len(before))
        while n < top and w[n] == before[n]:
            n += 1
        del best[n + 1:], count[n + 1:]
        for i in range(n + 1, len(w) + 1):
            s, c = -math.inf, 0
            for j in range(i - 1, -1, -1):
                piece = w[j:i]
                if piece not in tails:
                    break
                p = score.get(piece)
                if p is not None:
                    t = best[j] + p
                    if t > s or t == s and count[j] + 1 < c:
                        s, c = t, count[j] + 1
            best.append(s)
            count.append(c)
        out.append(count[len(w)])
        before = w
    return out


def pre_tokens(buf: np.ndarray, offs: np.ndarray) -> Words:
    """All pre-tokens, which cover the texts."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return Words(buf, z, z, np.zeros(len(offs), np.int64))
    space = (buf == 0x20) | ((buf >= 9) & (buf <= 13))
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    prev = np.concatenate([[True], space[:-1]])
    word = ~space & (prev | edge[:-1])              # a word begins
    lead = np.zeros(len(buf), bool)                 # the space in front of it
    lead[:-1] = word[1:] & (buf[:-1] == 0x20) & ~edge[1:-1]
    start = lead | edge[:-1] | (word & ~np.concatenate([[False], lead[:-1]])) | (space & ~prev)
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(buf))
    return Words(buf, starts, ends, np.searchsorted(starts, offs))


COUNTED = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])


def _counter(shared):
    def make():
        pieces, memo = shared.value, {}

        def run(column: pa.Array) -> list:
            sizes, pre, tokens = [], [], []
            for lo, hi, buf, offs in text_chunks(column):
                w = pre_tokens(buf, offs)
                h, at, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
                if len(memo) > MEMO:
                    memo.clear()
                keys = h.tolist()
                fresh = sorted((w.word(at[k]), x) for k, x in enumerate(keys) if x not in memo)
                for (_, x), c in zip(fresh, count_sorted([f[0] for f in fresh], pieces)):
                    memo[x] = c
                each = np.array([memo[x] for x in keys], np.int64)[inverse] if keys else np.zeros(0, np.int64)
                total = np.concatenate([[0], np.cumsum(each)])
                sizes.append(np.diff(offs))
                pre.append(w.counts)
                tokens.append(total[w.first[1:]] - total[w.first[:-1]])
            join = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64())
            return [join(sizes), join(pre), join(tokens)]
        return run
    return make


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_pretokens and n_tokens of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(load(vocabulary))  # the vocabulary's pieces
    return annotate(docs.select("doc_id", "text"), "text", COUNTED, _counter(shared)).drop("text")
