"""A corpus pipeline of five stages, each an operator of quern.llm; a stage's result is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, mixing, near_dedup, quality_rules, sharding
from quern.llm.common import delete, discarded, documents, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their own rules and whose host passes."""
    return quality_rules.kept(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar to 0.8 or more."""
    return near_dedup.deduplicated(docs, 5, 80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources reach their target weights."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with size, text_crc32, curve, shard and slot; input columns of these names as input_size and so on."""
    return sharding.hilbert_shards(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-duplicates", dedup),
    ("benchmark decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Near-duplicate groups and entropy balancing are iterative; the test runs brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage leaves in the shared folder, and its input, are deleted once its result is written."""
    docs = documents(spark, sf_dir)
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with discarded(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        if k:
            delete(spark, f"{base}/{k - 1}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
