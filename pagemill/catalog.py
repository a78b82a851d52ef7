"""All queries of the document engine, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.plans import layout, lifecycle, text


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with structure to Markdown, scored."""
    return text.structure_score(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return text.QUERIES | layout.QUERIES | lifecycle.QUERIES


def oracle_sql() -> dict[str, str]:
    return text.ORACLES | layout.ORACLES | lifecycle.ORACLES
