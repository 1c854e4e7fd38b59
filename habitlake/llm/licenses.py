r"""License scans by an exact set-similarity join (op8).

Templates are word sets of license notices; a text block is a line of a text, as a word set. Words of templates are
ordered from rare to frequent by their counts in all documents. A block that holds ``THRESHOLD`` of a template's words
must hold one of its first words in that order (prefix filter), have enough words (length filter), and have enough words
left on either side of the first common one (positional filter); what passes is verified by counting. The templates are
a fixed list, so their index is broadcast and texts are streamed without a shuffle.

Words: A-Z lower-cased, `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`. Base phrases are consecutive words, also across lines.

Cases: null and empty texts have no words and no labels, score 0; repeated rows are scanned each by itself; an empty
corpus orders words by name; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate
from .words import ALNUM, LOWER, split_words, text_chunks

# fixed values: phrases and labels of the base rule
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# fixed values: opening sentences of public license notices
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.8


def _word_hashes(words: list[str]) -> np.ndarray:
    out = [w.encode() for w in words]
    buf = np.frombuffer(b" ".join(out), np.uint8)
    return split_words(buf, np.array([0, len(buf)]), ALNUM).hashes()


def _parsed(buf, offs):
    w = split_words(LOWER[buf], offs, ALNUM)
    return w, w.hashes()


def _numbers(vocabulary: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted vocabulary, or -1."""
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at, -1)


class Index:
    """Prefix index of the templates over words in global order."""

    def __init__(self, templates, vocabulary: np.ndarray, counts: np.ndarray, threshold: float):
        self.vocabulary = vocabulary
        rank = np.empty(len(vocabulary), np.int64)
        rank[np.lexsort((vocabulary, counts))] = np.arange(len(vocabulary))
        self.rank = rank
        self.labels = [t[0] for t in templates]
        self.sets = [np.unique(rank[_numbers(vocabulary, _word_hashes(t[1].split()))]) for t in templates]
        self.least = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.first = np.zeros(len(vocabulary), bool)
        self.by_word: dict[int, list] = {}
        for t, (s, least) in enumerate(zip(self.sets, self.least)):
            for i, r in enumerate(s[:len(s) - least + 1].tolist()):
                self.first[r] = True
                self.by_word.setdefault(r, []).append((t, i))

    def matches(self, block: np.ndarray, words: int):
        """(template, containment) of a block, as the sorted ranks of its template words and its number of words."""
        seen = set()
        for j, r in enumerate(block.tolist()):
            for t, i in self.by_word.get(r, ()):
                if t in seen:
                    continue
                seen.add(t)  # the first common prefix word: none in front of it is shared
                s, least = self.sets[t], self.least[t]
                if words >= least and 1 + min(len(s) - i - 1, len(block) - j - 1) >= least:
                    both = len(np.intersect1d(s, block, assume_unique=True))
                    if both >= least:
                        yield t, both / len(s)


def word_counts(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences of the vocabulary's words in all documents."""
    def count(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for b in batches:
            for _, _, buf, offs in text_chunks(b.column(0)):
                n = _numbers(vocabulary, _parsed(buf, offs)[1])
                total += np.bincount(n[n >= 0], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["w", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for r in docs.select("text").mapInArrow(count, "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).collect():
        out[r["w"]] = r["n"]
    return out


FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
                      T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_blocks", T.LongType())])


def _scanner(shared):
    def make():
        index = shared.value
        phrases = [(_word_hashes(p.split()), label) for p, label in PHRASES]

        def run(column: pa.Array) -> list:
            rows = []
            for lo, hi, buf, offs in text_chunks(column):
                w, h = _parsed(buf, offs)
                doc = w.docs()
                found = [[] for _ in range(hi - lo)]
                for p, label in phrases:
                    k = len(p)
                    if len(h) >= k:
                        ok = doc[:len(h) - k + 1] == doc[k - 1:]
                        for j in range(k):
                            ok &= h[j:len(h) - k + 1 + j] == p[j]
                        for i in np.flatnonzero(ok).tolist():
                            found[doc[i]].append((i - int(w.first[doc[i]]), label))
                # lines: a block begins with each text and after each line feed
                cut = np.union1d(np.flatnonzero(buf == 10) + 1, offs[:-1])
                block = np.searchsorted(cut, w.starts, side="right")
                n = _numbers(index.vocabulary, h)
                known = np.flatnonzero(n >= 0)
                rank = index.rank[n[known]]
                hot = np.unique(block[known][index.first[rank]])
                some = np.isin(block[known], hot)
                pairs = np.unique(np.stack([block[known][some], rank[some]], axis=1), axis=0)
                sizes = np.bincount(block, minlength=int(block.max(initial=0)) + 1)
                ends = np.append(np.flatnonzero(np.diff(pairs[:, 0])) + 1, len(pairs)) if len(pairs) else []
                labels = [set() for _ in range(hi - lo)]
                score, count = np.zeros(hi - lo), np.zeros(hi - lo, np.int64)
                a = 0
                for e in ends:
                    b = int(pairs[a, 0])
                    d = int(np.searchsorted(offs, cut[b - 1], side="right")) - 1
                    got = list(index.matches(pairs[a:e, 1], int(sizes[b])))
                    for t, c in got:
                        labels[d].add(index.labels[t])
                        score[d] = max(score[d], c)
                    count[d] += bool(got)
                    a = e
                for d in range(hi - lo):
                    base = {x[1] for x in found[d]}
                    at = [x[0] for x in found[d]]
                    rows.append((int(w.counts[d]), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels[d])),
                                 1.0 if base else float(score[d]), int(count[d])))
            return [list(c) for c in zip(*rows)] if rows else [[] for _ in FOUND]
        return run
    return make


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and the findings of every row: base places, labels, the highest containment (1 with a base phrase), and the
    number of matching blocks."""
    vocabulary = np.unique(np.concatenate([_word_hashes(t[1].split()) for t in templates]))
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates, vocabulary, word_counts(docs, vocabulary), threshold))  # the fixed templates
    return annotate(docs.select("doc_id", "text"), "text", FOUND, _scanner(shared)).drop("text")
