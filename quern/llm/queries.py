"""The corpus operators as registered queries, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, importance, katz, mixing, near_dedup, oracles, quality_rules, repeats, sharding, token_output, toxicity
from .common import documents


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": lambda spark, d: sharding.op1(documents(spark, d)),
        "op2_mixing": lambda spark, d: mixing.op2(documents(spark, d)),
        "op3_quality_rules": lambda spark, d: quality_rules.op3(documents(spark, d)),
        "op4_repeats": lambda spark, d: repeats.op4(documents(spark, d)),
        "op5_importance": lambda spark, d: importance.op5(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
        "op6_katz_backoff": lambda spark, d: katz.op6(documents(spark, d)),
        "op7_benchmark_decontamination": lambda spark, d: decontaminate.op7(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")),
        "op8_toxicity": lambda spark, d: toxicity.op8(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
        "op9_near_dedup": lambda spark, d: near_dedup.op9(documents(spark, d)),
        "op10_token_output": lambda spark, d: token_output.op10(documents(spark, d)),
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
