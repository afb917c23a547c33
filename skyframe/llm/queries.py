"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("lm_scoring", "topk_search", "bpe", "minhash_dedup", "mixing", "line_dedup", "sharding", "quality_rules", "token_counts", "quality_classifier", "conversation_repair", "license_scan", "source_divergence")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in importlib.import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in importlib.import_module(f"{__package__}.{m}").ORACLE.items()}
