"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, source mixing, BPE ids.

Every stage takes what the one before kept, written as Parquet and read again, and all but the last return the
columns of ``documents``. Its rows can't be expressed in SQL (ORACLE_SQL); ``tests/llm/test_pipeline.py``
holds the first three stages against brute force, and the last two as parts of the whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyframe.llm import bpe, line_dedup, minhash_dedup, mixing, quality_rules
from skyframe.llm.common import stage_table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("minhash_dedup", minhash_dedup.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
