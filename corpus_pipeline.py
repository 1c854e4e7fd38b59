"""A training-data pipeline over ``documents``: each stage works on all that the one before has kept.

Stages: rows that the quality classifier rejects go; one document of each near-duplicate group (five-word shingles,
Jaccard similarity of 0.8 or more) stays; contaminated documents go; personal data is replaced by its kind; sources are
mixed to their target weights (a row for each pass over a remaining document, with the ``mix_taken`` words taken in it).
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from habitlake.llm import jaccard, mixing, pii, suffixes, votes  # noqa: E402
from habitlake.llm.common import table  # noqa: E402
from habitlake.session import configure, ensure_checkpoint_dir  # noqa: E402


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return votes.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return jaccard.one_of_each(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return mixing.mixture(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("redact", redact), ("mix", mix)]

#: the stages learn models and pick rows by seeded hashes: not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written as Parquet in the shared folder and read again."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    root = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{name}")
    return docs
