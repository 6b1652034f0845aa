"""All registered queries of the findings, dependency, graph and event engines, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ironsieve.plans import code, dependencies, events, findings, graph
from ironsieve.plans.registry import Query

_PARTS = (findings.query, dependencies.query, events.query, graph.query, code.query)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.scan_summary(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {k: v for part in _PARTS for k, v in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _PARTS for k, v in part.sql.items()}
