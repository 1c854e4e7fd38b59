"""Vectorised words of Arrow string columns, used inside tasks.

A column is taken in chunks of whole texts: one byte buffer and the offsets
of each text in it. Words are runs of bytes of a class (UTF-8 continuation
bytes count as the class says), so every step is a numpy pass over bytes.
Word hashes are 64-bit polynomial hashes with a final mix; the constants come
from splitmix64 and are the same in every process.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21

_U = np.uint64


def splitmix(x: np.ndarray | int) -> np.ndarray:
    """The splitmix64 mix of each value (wrapping 64-bit arithmetic)."""
    with np.errstate(over="ignore"):
        z = np.asarray(x, dtype=_U) + _U(0x9E3779B97F4A7C15)
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


_BYTE = splitmix(np.arange(1, 257))
_STEP = splitmix(np.arange(1000, 1100)) | _U(1)  # odd multipliers for positions in an n-gram
_BASE = 0xD6E8FEB86659FD93
_INV = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 64)
        for i, b in enumerate((_BASE, _INV)):
            p = np.full(size, b, _U)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0], _powers[1]


#: bytes that are not ASCII white space: words `[^\x20\x09-\x0D]+`
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: lower-case letters, digits and all of non-ASCII: words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    """Words of a chunk: byte ranges in ``buf``; ``first[d]:first[d+1]`` are the words of text d."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, _U)
        up, down = _tables(len(self.buf) + 1)
        with np.errstate(over="ignore"):
            total = np.empty(len(self.buf) + 1, _U)
            total[0] = 0
            np.cumsum(_BYTE[self.buf] * up[: len(self.buf)], out=total[1:])
            return splitmix((total[self.ends] - total[self.starts]) * down[self.starts])

    def column(self, at: np.ndarray) -> pa.Array:
        """The words at the given places, as an Arrow column of bytes."""
        starts, size = self.starts[at], self.ends[at] - self.starts[at]
        offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        flat = self.buf[np.repeat(starts - offs[:-1], size) + np.arange(offs[-1])]
        return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offs), pa.py_buffer(flat)])

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i]:self.ends[i]].tobytes()


def text_chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES):
    """(lo, hi, buf, offsets) of runs of texts of at most max_bytes, or of one longer text; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def split_words(buf: np.ndarray, offs: np.ndarray, member: np.ndarray) -> Words:
    """Maximal runs of bytes of the class ``member``, never across texts."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return Words(buf, z, z, np.zeros(len(offs), np.int64))
    inside = member[buf]
    edge = np.zeros(len(buf) + 1, bool)  # a text begins here
    edge[offs] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before &= ~edge[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(buf, starts, ends, np.searchsorted(starts, offs))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (the last n-1 positions have none); texts are not told apart."""
    if len(h) < n:
        return np.zeros(0, _U)
    m = len(h) - n + 1
    with np.errstate(over="ignore"):
        acc = h[:m] * _STEP[0]
        for j in range(1, n):
            acc += h[j:j + m] * _STEP[j]
    return splitmix(acc)


def inside_text(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """For each of the ``total - n + 1`` positions: the n words from there on lie in one text."""
    ok = np.ones(max(total - n + 1, 0), bool)
    for j in range(1, n):
        cut = first[1:-1] - j  # a text begins at first[d]; positions just before it reach over
        cut = cut[(cut >= 0) & (cut < len(ok))]
        ok[cut] = False
    return ok
