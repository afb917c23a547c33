"""The registered queries over the given tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import base

for _name in ("positions", "aggregates", "detectors", "frames", "tables"):
    importlib.import_module(f"{__package__}.{_name}")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: where each aircraft is now, and how odd that is."""
    return base.QUERIES["g4_latest_scored"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
