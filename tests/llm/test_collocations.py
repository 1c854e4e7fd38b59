"""Collocations against counting every phrase in plain Python."""

import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from habitlake.llm import collocations as C


def plain(rows, threshold, most=5, k=2000):
    """The contract, phrase by phrase."""
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(ws)
            for n in range(1, most + 1):
                for i in range(len(ws) - n + 1):
                    f[lang, tuple(ws[i:i + n])] += 1
    often = {p: c for p, c in f.items() if c >= threshold}
    out = {}
    for (lang, ws), a in often.items():
        if len(ws) < 2:
            continue
        longer = [(q, c) for (g, q), c in often.items() if g == lang and len(q) > len(ws) and any(q[i:i + len(ws)] == ws for i in range(len(q)))]
        if any(100 * c >= 100 * a for _, c in longer):
            continue
        n = total[lang]
        s, cut = min((Fraction(1000 * a * n, f[lang, ws[:i]] * f[lang, ws[i:]]).__floor__(), i) for i in range(1, len(ws)))
        out.setdefault(lang, []).append((-s, -a, " ".join(ws).encode(), a, f[lang, ws[:cut]], f[lang, ws[cut:]], n, s))
    return sorted((lang, r, x[2].decode(), *x[3:]) for lang, xs in out.items() for r, x in enumerate(sorted(xs)[:k], 1))


def got(df):
    return sorted(tuple(r) for r in df.collect())


def rows_of(df):
    return [(r["lang"], r["text"]) for r in df.select("lang", "text").collect()]


def test_odd_rows_against_plain_counts(odd, none):
    for threshold in (2, 4):
        assert got(C.top(odd, threshold=threshold)) == plain(rows_of(odd), threshold)
    assert got(C.top(none)) == []


def test_real_rows_against_plain_counts(real):
    rows = rows_of(real)
    assert got(C.top(real, k=25, threshold=30)) == plain(rows, 30, k=25)
    assert got(C.top(real, threshold=60, max_words=3)) == plain(rows, 60, most=3)


@pytest.fixture(scope="module")
def small(spark):
    words = ["a", "b", "the", "é\x01", "\x00", "the\x01", "B"]
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(words, rng.integers(1, 60), p=[.2, .1, .3, .1, .1, .1, .1])) + ".," for _ in range(300)]
    rows = [([None, "und", "x\ty", "de"][i % 4], t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(x, t, i) for i, (x, t) in enumerate(rows)], "lang string, text string, gram long"), rows


def test_ranges_cut_anywhere(spark, small):
    """Many ranges over few phrases: what begins a range's first phrase comes from before it."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = plain(small[1], 3)
    try:
        for n in (1, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert got(C.top(small[0], threshold=3)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_long_texts_in_blocks_count_alike(monkeypatch):
    text = pa.array(["One two, one two three one two. " * 40, None, "two three"])
    langs = pa.array([0, 0, 1], pa.int32())

    def counts(n):
        total = Counter()
        for w, lang, joined, begin in C._blocks(text, langs, n):
            for g, p, c in zip(*(x.tolist() if isinstance(x, np.ndarray) else x.to_pylist() for x in C._phrases(w, lang, joined, begin, n, None, []))):
                total[g, p] += c
        return total
    whole = [counts(n) for n in range(1, 6)]
    assert whole[1][0, "one two"] == 120 and whole[1][0, "two one"] == 0 and whole[1][1, "two three"] == 1
    for block in (1, 2, 7):
        monkeypatch.setattr(C, "BLOCK", block)
        assert [counts(n) for n in range(1, 6)] == whole


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**13 + 1, 9 * 10**14 + 7, [10**13 + 9, 10**13 + 3], [10**13 + 5, 10**13 + 8]), (100, 10**14 + 3, [100], [100]), (7, 50, [9, 8], [8, 9])]
    out = C.score(spark.createDataFrame(rows, "a long, n long, lefts array<long>, rights array<long>")).collect()
    for r, (a, n, lefts, rights) in zip(sorted(out, key=lambda r: -r["a"]), sorted(rows, key=lambda r: -r[0])):
        s, k = min((1000 * a * n // (lefts[k - 1] * rights[len(rights) - k]), k) for k in range(1, len(lefts) + 1))
        assert (r["score"], r["l"], r["r"]) == (s, lefts[k - 1], rights[len(rights) - k])


def test_all_in_one_piece_and_extension_of_equal_count(spark):
    df = spark.createDataFrame([("en", "new york city hall. " * 5 + "new york. york city, city hall")], "lang string, text string")
    assert got(C.top(df, threshold=2)) == plain([("en", "new york city hall. " * 5 + "new york. york city, city hall")], 2)
