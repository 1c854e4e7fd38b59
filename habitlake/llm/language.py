r"""Language identification (op7): averaged hashed subword embeddings with a linear softmax.

A text is the mean of its subwords' embeddings; subwords are the runs of one to four bytes inside words (ASCII capitals
folded), hashed to ``BUCKETS`` rows. Embeddings and softmax are trained by stochastic gradient descent in numpy on a
bounded sample of documents with a language. A tenth of the sample calibrates: a temperature for the probability, and
the least probability from which on ``ACCEPTED`` of the predictions are right; below it a prediction is marked
``rejected``. Trained, embedding and softmax are one product (a score per bucket and language), broadcast to the tasks
that stream all documents.

Cases: null text, text without a letter, and any text where nothing could be learned from are `und` with score 0;
repeated rows get the same answer; rows without an id or language are predicted but never learned from; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, fold
from .words import ALNUM, LOWER, splitmix, text_chunks

#: documents learned from, at most: those of the lowest id hash
SAMPLE_ROWS = 3000
BUCKETS = 1 << 13
DIMS = 16
EPOCHS, BATCH, RATE, SEED = 15, 32, 4.0, 11
ACCEPTED = 0.99

_LETTER = ALNUM.copy()
_LETTER[0x30:0x3A] = False


def subwords(buf: np.ndarray, offs: np.ndarray):
    """(buckets, place) of the subwords of 1 to 4 bytes that start at each place and end in the same word and text."""
    low = LOWER[buf].astype(np.uint64)
    inside = _LETTER[LOWER[buf]]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    code, ok = np.zeros(len(buf), np.uint64), np.ones(len(buf), bool)
    for k in range(4):
        m = len(buf) - k
        if m <= 0:
            return
        code, ok = code[:m] << np.uint64(8) | low[k:], ok[:m] & inside[k:]
        if k:
            ok = ok & ~edge[k:k + m]
        at = np.flatnonzero(ok)
        yield (splitmix(code[at] + np.uint64(k << 32)) >> np.uint64(64 - 13)).astype(np.int64), at


def histograms(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Shares of the buckets among the subwords of each text (0 without any)."""
    n = len(offs) - 1
    total = np.zeros(n * BUCKETS)
    text = np.repeat(np.arange(n), np.diff(offs))
    for b, at in subwords(buf, offs):
        total += np.bincount(text[at] * BUCKETS + b, minlength=n * BUCKETS)
    total = total.reshape(n, BUCKETS)
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1)


@dataclass
class Model:
    langs: list
    scores: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        total, count = np.zeros((n, len(self.langs))), np.zeros(n)
        for b, at in subwords(buf, offs):
            cut = np.searchsorted(at, offs)
            got = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.scores[b], axis=0)])
            total += got[cut[1:]] - got[cut[:-1]]
            count += cut[1:] - cut[:-1]
        return total / np.maximum(count, 1)[:, None] + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, langs: list) -> Model:
    rng = np.random.default_rng(SEED)
    emb = rng.normal(0, 0.3, (BUCKETS, DIMS))
    out, bias = rng.normal(0, 0.3, (DIMS, len(langs))), np.zeros(len(langs))
    held = np.arange(len(y)) % 10 == 9
    rows = np.flatnonzero(~held)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for part in np.array_split(rng.permutation(rows), max(1, len(rows) // BATCH)):
            xb = x[part]
            mean = xb @ emb
            err = softmax(mean @ out + bias)
            err[np.arange(len(part)), y[part]] -= 1
            err /= len(part)
            grad = err @ out.T
            out -= rate * (mean.T @ err)
            bias -= rate * err.sum(axis=0)
            emb -= rate * 20 * (xb.T @ grad)
    return Model(langs, (emb @ out).astype(np.float64), bias)


def calibrate(model: Model, z: np.ndarray, y: np.ndarray) -> Model:
    if len(y):
        loss = {t: -np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in np.geomspace(0.02, 20, 61)}
        model.temperature = float(min(loss, key=lambda t: (loss[t], t)))
        p = softmax(z / model.temperature)
        top, right = p.max(axis=1), p.argmax(axis=1) == y
        order = np.argsort(-top, kind="stable")
        good = np.cumsum(right[order]) >= ACCEPTED * np.arange(1, len(y) + 1)
        model.least = float(top[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return model


def fit(docs: DataFrame, folds: int = 4, held: int = 2, sample_rows: int = SAMPLE_ROWS) -> Model:
    known = (docs.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).where(F.col("_lang").isNotNull() & (fold(F.col("_id"), folds) != held))
             .orderBy(F.xxhash64("_id"), "_id", "_lang").limit(sample_rows))
    rows = docs.select(F.col("doc_id").alias("_i"), F.col("lang").alias("_l"), F.col("text").alias("_text")).join(
        F.broadcast(known.distinct()), (F.col("_i") == F.col("_id")) & (F.col("_l") == F.col("_lang"))).dropDuplicates(["_id", "_lang"])  # bounded by sample_rows

    def make():
        def run(column: pa.Array) -> list:
            out = []
            for _, _, buf, offs in text_chunks(column, 1 << 18):
                out += [r.astype(np.float16).tobytes() for r in histograms(buf, offs)]
            return [out]
        return run

    got = annotate(rows, "_text", T.StructType([T.StructField("_x", T.BinaryType())]), make).select("_id", "_lang", "_x").collect()
    got.sort(key=lambda r: (r["_id"], r["_lang"]))
    langs = sorted({r["_lang"] for r in got})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    x = np.stack([np.frombuffer(r["_x"], np.float16) for r in got]).astype(np.float32)
    y = np.array([langs.index(r["_lang"]) for r in got])
    model = train(x, y, langs)
    held_back = np.arange(len(y)) % 10 == 9
    return calibrate(model, x[held_back] @ model.scores + model.bias, y[held_back])


def _has_letter(text) -> bool:
    return text is not None and any(c.isalpha() for c in text)


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
_ASCII = np.zeros(256, bool)
_ASCII[0x41:0x5B] = _ASCII[0x61:0x7B] = True


def _predictor(shared):
    def make():
        model = shared.value

        def run(column: pa.Array) -> list:
            lang, score, rejected = [], [], []
            for lo, hi, buf, offs in text_chunks(column):
                letters = np.concatenate([[0], np.cumsum(_ASCII[buf])])
                plain = letters[offs[1:]] > letters[offs[:-1]]
                p = softmax(model.logits(buf, offs) / model.temperature) if model.langs else np.zeros((hi - lo, 1))
                top = p.argmax(axis=1)
                for d in range(hi - lo):
                    known = bool(model.langs) and (plain[d] or _has_letter(column[lo + d].as_py()))
                    lang.append(model.langs[top[d]] if known else "und")
                    score.append(float(p[d, top[d]]) if known else 0.0)
                    rejected.append(not known or score[-1] < model.least)
            return [lang, score, rejected]
        return run
    return make


def identify(docs: DataFrame, **fitting) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row (held_out is false for a null id)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, **fitting))  # BUCKETS x languages of the sample
    held = F.coalesce(fold(F.col("doc_id"), fitting.get("folds", 4)) == fitting.get("held", 2), F.lit(False))
    return annotate(docs.select("doc_id", "text"), "text", PREDICTED, _predictor(shared)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
