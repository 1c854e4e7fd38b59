"""BPE by speculation and verification against the tokenizers library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from habitlake.llm import bpe

from .conftest import pairs

ODD = ["Hello<|endoftext|> World's naïve I'M ﬁ İ", "<|startoftext|>", "x<|startoftext|><|endoftext|>y <|start", "é é é́", "　中文 \x85x\x1cy z",
       "ΑΣ ΣΑΣ ßẞ ǅ ŉ 𝒳 😀😀", "'S 'Ll don't 12345 ...!!!", "   ", "", "̈a ̀", "a b﻿c​d", "\x00\x01 \x7f"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def encoder():
    text, merges, _ = bpe.load()
    return bpe.Encoder(text, merges)


def check(df, library):
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(df).collect()), key=repr)
    want = []
    for doc, text in pairs(df):
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        want.append((doc is None, doc, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_real_odd_and_empty_tables(real, odd, none, library):
    check(real, library)
    check(odd, library)
    check(none, library)


def test_odd_texts(spark, library):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    check(df, library)
    rows = bpe.decode(bpe.encode(df)).orderBy("doc_id").collect()
    assert [r["decoded"] for r in rows] == [library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for t in ODD]


def test_random_words_whatever_the_block(library, encoder, monkeypatch):
    rng = random.Random(1)
    raws = ["".join(rng.choice("abcdeinorst'é!1") for _ in range(rng.randint(1, 30))) for _ in range(3000)] + ["ab" * 4000, "!" * 999]
    want = [np.array(library.encode(r, add_special_tokens=False).ids, "<u4").tobytes() for r in raws]
    assert encoder.words([r.encode() for r in raws]) == want
    assert 0 < encoder.failed < encoder.seen  # some proposals stand, some are merged exactly
    for name in ("BLOCK", "WORDS", "SHORT"):
        monkeypatch.setattr(bpe, name, 7)
    encoder.known = dict(encoder.fixed)
    assert encoder.words([r.encode() for r in raws[:300]]) == want[:300]
    text, merges, _ = bpe.load()
    run = bpe._encoder(type("Shared", (), {"value": (text, merges)}))()
    column = pa.array([None, " ".join(raws[:100]), "", "one two", " ".join(raws[50:90])])
    n, ids = run(column)
    assert ids.to_pylist() == [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in column.to_pylist()]


def test_pairs_are_judged_as_merging_does(encoder):
    """Every verdict on random adjacent tokens against merging the pair's symbols."""
    m = encoder.m
    inner = np.array([i for i in range(m.size) if m.rank[i] >= 0 or i in set(encoder.inner.values())])
    rng = np.random.default_rng(3)
    a, b = rng.choice(inner, 3000), rng.choice(inner, 3000)

    def symbols(t):
        return [t] if m.rank[t] < 0 else symbols(m.left[t]) + symbols(m.right[t])
    final = set(encoder.final.values())
    for x, y, good in zip(a.tolist(), b.tolist(), m.compatible(a, b).tolist()):
        left = symbols(x)
        if set(left) & final or any(bpe.merge_exactly(encoder.rank, encoder.token, symbols(t)) != [t] for t in (x, y)):
            continue  # ends a word, or is not what merging gives for itself
        assert good == (bpe.merge_exactly(encoder.rank, encoder.token, left + symbols(y)) == [x, y])


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError):
        path = tmp_path / "v.json"
        path.write_text('{"added_tokens": [], "model": {"type": "WordPiece", "vocab": {}}}')
        bpe.load(str(path))


def test_null_ids_decode_to_nothing(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bpe.decode(df).select("decoded", F.col("doc_id")).first()["decoded"] == ""
