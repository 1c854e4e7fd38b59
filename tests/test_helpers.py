"""Core helpers against their plain equivalents on seeded random data."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from habitlake.functions.exprs import null_split_left_join
from habitlake.functions.windows import running_sum


def test_chunked_running_sum_equals_window(spark):
    rnd = random.Random(21)
    rows = []
    for i in range(3000):
        user = 0 if rnd.random() < 0.6 else rnd.randrange(1, 5)  # one hot key
        at = dt.datetime(2024, 1, 1, rnd.randrange(24), rnd.randrange(60), rnd.randrange(60))
        rows.append((i, user, at, rnd.randrange(-20, 21)))
    df = spark.createDataFrame(rows, "id long, user_id long, at timestamp_ntz, v int")
    got = running_sum(df, ["user_id"], ["at", "id"], "v", "run", chunk=F.date_trunc("minute", F.col("at")))
    w = Window.partitionBy("user_id").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("run", F.sum("v").over(w))
    assert sorted((r.id, r.run) for r in got.collect()) == sorted((r.id, r.run) for r in want.collect())


def test_null_split_left_join_equals_left_join(spark):
    left = spark.createDataFrame([(1, 10), (2, None), (3, 11), (4, None), (5, 99)], "id long, k long")
    right = spark.createDataFrame([(10, "a"), (11, "b")], "k long, name string")
    got = null_split_left_join(left, right, "k")
    want = left.join(right, "k", "left")
    key = lambda r: (r.id, r.k, r.name)
    assert sorted(map(key, got.collect()), key=repr) == sorted(map(key, want.collect()), key=repr)
