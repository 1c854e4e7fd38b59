"""Quality classifier by nearest-neighbour voting (op9).

A bounded sample of labelled documents is turned into latent-semantic vectors
(hashed term weights, truncated SVD); the vectors are broadcast, every
document's exact cosine with each of them is computed in blocks, and the
labels of the nearest vote with their similarity as weight.

Cases: null or empty text has no terms, so no neighbour, and scores the sample's share of label 1 (0.5 without any
labelled row); repeated rows score alike; several labels of one document count as their majority (ties: 1); rows with a
null id are scored but never learned from; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, fold, rows_with
from .words import NOT_SPACE, splitmix, split_words, text_chunks

#: labelled rows learned from, at most (lowest id hashes)
SAMPLE_ROWS = 3000
DIMS = 64
NEIGHBOURS = 15
BLOCK = 256

SHAPES, TERMS, MARKS = 2048, 512, 64
WIDTH = SHAPES + TERMS + MARKS

# byte classes of the shape terms: letters, capitals, digits, white space and each ASCII sign of its own
_CLASS = np.zeros(256, np.int64)
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[0x20, 9, 11, 12, 13]] = 3
_CLASS[10] = 4
_signs = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_CLASS[_signs] = 5 + np.arange(len(_signs))


def _scaled(m: np.ndarray) -> np.ndarray:
    """Square roots of the shares in a row: length 1, or 0 without terms."""
    return np.sqrt(m / np.maximum(m.sum(axis=1, keepdims=True), 1))


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Term weights of each text: trigrams of byte classes, hashed words, and marks of repetition, length and variety."""
    n = len(offs) - 1
    w = split_words(buf, offs, NOT_SPACE)
    per = w.counts
    text_of = np.repeat(np.arange(n), np.diff(offs))
    if len(buf) >= 3:
        c = _CLASS[buf]
        tri = (splitmix((c[:-2] << 12) | (c[1:-1] << 6) | c[2:]) % np.uint64(SHAPES)).astype(np.int64)
        whole = text_of[:-2] == text_of[2:]
        shapes = np.bincount((text_of[:-2] * SHAPES + tri)[whole], minlength=n * SHAPES).reshape(n, SHAPES)
    else:
        shapes = np.zeros((n, SHAPES))
    h, d = w.hashes(), w.docs()
    terms = np.bincount(d * TERMS + (h % np.uint64(TERMS)).astype(np.int64), minlength=n * TERMS).reshape(n, TERMS)
    marks = np.zeros((n, MARKS))
    least = np.maximum(per, 1)
    for lag in (1, 2):  # words that repeat the one before, or the one before that
        if len(h) > lag:
            same = (h[lag:] == h[:-lag]) & (d[lag:] == d[:-lag])
            marks[:, lag - 1] = 4 * np.bincount(d[lag:][same], minlength=n) / least
    order = np.lexsort((h, d))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (d[order][1:] != d[order][:-1])
    variety = np.bincount(d[order][new], minlength=n) / least
    length = np.bincount(d, weights=w.ends - w.starts, minlength=n) / least
    rows = np.arange(n)
    marks[rows, 8 + np.minimum((variety * 10).astype(int), 10)] = 0.5
    marks[rows, 20 + np.minimum(np.log2(least).astype(int), 19)] = 0.25
    marks[rows, 42 + np.minimum(length.astype(int), 20)] = 0.25
    marks[per == 0] = 0
    return np.concatenate([_scaled(shapes), 0.3 * _scaled(terms), marks], axis=1).astype(np.float32)


@dataclass
class Voters:
    """Labelled vectors: ``basis`` maps centred term weights to ``vectors``' space."""

    mean: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.basis
        z[~x.any(axis=1)] = 0
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest, for each row of term weights."""
        if not len(self.labels):
            return np.full(len(x), self.prior)
        cos = self.project(x) @ self.vectors.T
        k = min(NEIGHBOURS, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cos, near, axis=1), 0).astype(np.float64) ** 4
        return ((weight * self.labels[near]).sum(axis=1) + 1e-6 * self.prior) / (weight.sum(axis=1) + 1e-6)


def _basis(x: np.ndarray, dims: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    k = min(dims, *x.shape)
    q = np.random.default_rng(7).standard_normal((x.shape[1], k)).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    return q


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1,
        sample_rows: int = SAMPLE_ROWS) -> Voters:
    """Learn from labelled documents outside the held-out fold, ``sample_rows`` at most: those of the lowest id hash."""
    known = (labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("_y"))
             .where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & (fold(F.col("_id"), folds) != held))
             .groupBy("_id").agg(F.avg("_y").alias("_y"))
             .orderBy(F.xxhash64("_id"), "_id").limit(sample_rows))
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    rows = texts.join(F.broadcast(known), "_id").dropDuplicates(["_id"])  # bounded by sample_rows

    def make():
        def run(column: pa.Array) -> list:
            out = []
            for _, _, buf, offs in text_chunks(column):
                out += [r.tobytes() for r in features(buf, offs).astype(np.float16)]
            return [out]
        return run

    got = annotate(rows, "_text", T.StructType([T.StructField("_x", T.BinaryType())]), make).select("_id", "_y", "_x").collect()
    got.sort(key=lambda r: r["_id"])
    if not got:
        return Voters(np.zeros(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    x = np.stack([np.frombuffer(r["_x"], np.float16) for r in got]).astype(np.float32)
    y = np.array([float(r["_y"] >= 0.5) for r in got])
    voters = Voters(x.mean(axis=0), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), y, float(y.mean()))
    voters.basis = _basis(x - voters.mean, DIMS)
    voters.vectors = voters.project(x)
    return voters


def _scorer(shared):
    def make():
        voters = shared.value

        def run(column: pa.Array) -> list:
            scores = [np.zeros(0)]
            for _, _, buf, offs in text_chunks(column):
                for lo in range(0, len(offs) - 1, BLOCK):
                    part = offs[lo:lo + BLOCK + 1]
                    scores.append(voters.score(features(buf[part[0]:part[-1]], part - part[0])))
            s = np.clip(np.concatenate(scores), 0.0, 1.0)
            return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
        return run
    return make


ADDED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def quality_scores(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """doc_id, held_out, score and predicted of every row (held_out is false for a null id)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **fitting))  # SAMPLE_ROWS x DIMS floats
    held = F.coalesce(fold(F.col("doc_id"), fitting.get("folds", 3)) == fitting.get("held", 1), F.lit(False))
    out = annotate(docs.select("doc_id", "text"), "text", ADDED, _scorer(shared))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """The rows of ``docs`` that are predicted to be of quality 1, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **fitting))
    return rows_with(docs, ADDED, _scorer(shared)).where("predicted = 1").select("_row.*")
