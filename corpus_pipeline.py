"""The corpus pipeline: documents in, token ids out, each stage written and read again.

Toxic documents go, then exact copies, then near copies; the sources left are mixed to
target weights, and the mix is encoded.  Every stage works on all rows of its
predecessor.  Null and repeated ids, null, empty and long texts, ties and extra columns are
treated as each operator's docstring says; an empty table runs through and gives no rows.
No SQL states the whole run (a learned classifier, hash permutations and
a tokenizer take part); tests compare it with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from daywatch.llm import exact_dedup, mixing, neardup, pieces, toxicity
from daywatch.llm.common import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean_documents(docs, labels)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_copies(docs, words=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # smaller tables of known cuts than the default, gone with the task: idle workers would
    # keep them beside the other stages
    return pieces.encode_documents(docs, keep=100_000, release=True)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
          ("mix_sources", mix), ("sentencepiece", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
