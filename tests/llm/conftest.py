import random

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       # names that operators use inside
                       T.StructField("score", T.StringType()), T.StructField("n", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("_text", T.StringType())])


def odd_rows():
    """Null and empty texts, null ids, repeated rows and ids, ties, near copies, shared passages, one very long text."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, base = say(60), say(120)
    near = base.split()
    near[50] = "CHANGED"
    texts = [None, "", " \n\t ", "one", "two words", "Zwei\x0bWörter", base, base, " ".join(near), base + " tail", say(34), say(35), shared, say(20) + " " + shared + "\n" + say(9),
             shared[:200] + " x " + shared[200:], "mail a.b@c.de, a@b.c_d@e.f 10.0.0.256 1.2.3.4.5.6.7.8 +49 (30) 1234-5678 4111 1111 1111 1111 4111-1111-1111-1112 +1 2 x+12",
             "Licensed under CC BY-NC 4.0.\nAll rights reserved. General public license\nReleased under the MIT License.", "12345 67890", "aa " * 40 + "\n" + "aa " * 40, say(3000) + " " + shared,
             "aaa\naaa\n\naaa \nbbb", "AB ab Ab aB", "Ä ä Ö", "中文 \U0001F600 x", "cc\nby cc-by"]
    rows = [(i if i % 7 else i, t, [None, "en", "de"][i % 3], [None, "b", "a", "c"][i % 4], None if t is None else len(t), None, i, None, None) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base, "en", "a", 1, "x", 0, 0, "y"), (None, None, None, None, None, None, None, None, None), (3, "another text with id three", "en", "a", 1, None, 1, 1, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
