"""All registered queries of the library and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from civicflow.plans import checks, dedup, events, matching, metrics, more, retrieval, selection, text

_AREAS = (dedup, text, retrieval, metrics, matching, events, more, selection, checks)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_clusters(spark, sf_dir)


def queries() -> dict:
    return {k: v for area in _AREAS for k, v in area.plans.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for area in _AREAS for k, v in area.plans.sql.items()}
