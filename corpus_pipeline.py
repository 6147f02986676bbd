"""A corpus pipeline of five stages; each is written as Parquet and read again as the documents of the next.

All stages but the last return the columns of ``documents``:

1. quality rules: rejected documents go;
2. near-duplicates (five-word shingles, similarity of 0.8 or more): one document of each group stays;
3. benchmark decontamination: contaminated documents go;
4. secret scan: secrets are replaced by a mark, all documents stay;
5. byte-level BPE: adds the ids of the whole text and their number.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandgauge.llm import bpe, decontaminate, near_dup, quality_rules, secrets
from demandgauge.session import working_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.judge(docs).filter("kept").select(*docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_duplicates(docs, k=5, share=(80, 100))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redact(docs, secrets.Forest(secrets.labelled_findings(spark)))
    return masked.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    codec = bpe.Codec(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return docs.withColumn("ids", codec.encode(F.col("text"))).withColumn("n_tokens", F.size("ids").cast("bigint"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_quality),
    ("near_dup", keep_one_copy),
    ("decontaminate", keep_uncontaminated),
    ("secrets", mask_secrets),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each has kept is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = os.path.join(working_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs


#: Sketches, a trained forest and BPE are no SQL; the stages are tested against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
