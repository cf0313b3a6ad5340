"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import corpus_queries, native_queries, repeat_queries, text_queries


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_MODULES = (native_queries, repeat_queries, text_queries, corpus_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for module in _MODULES:
        found.update(module.QUERIES)
    found["pipeline"] = _pipeline
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for module in _MODULES:
        found.update(module.ORACLES)
    return found
