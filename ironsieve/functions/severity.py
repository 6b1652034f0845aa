"""Severities, their ranks and the scales that map to them, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANKS = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
NPM = {"critical": "critical", "high": "high", "moderate": "medium", "low": "low", "info": "info"}
SEMGREP = {"ERROR": "critical", "WARNING": "high", "INFO": "medium"}
TRIVY = {"CRITICAL": "critical", "HIGH": "high", "MEDIUM": "medium", "LOW": "low"}


def lookup(key: Column, table: dict, otherwise) -> Column:
    """The table's value of a key; a key that is null or not there gives ``otherwise``."""
    out = F
    for k, v in table.items():
        out = out.when(key == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(otherwise))


def rank(severity: Column, unknown: int = 999) -> Column:
    return lookup(severity, RANKS, unknown)


def name_of(value: Column) -> Column:
    """The severity of a rank from 0 (critical) to 3; beyond that low."""
    return F.when(value == 0, "critical").when(value == 1, "high").when(value == 2, "medium").otherwise("low")


def impact_rank(count: Column) -> Column:
    """Rank by how many are affected: more than 100, 10, 1."""
    return F.when(count > 100, 0).when(count > 10, 1).when(count > 1, 2).otherwise(3)


def title_rank(title: Column) -> Column:
    low = F.lower(title)
    return (
        F.when(F.startswith(low, F.lit("securityerror")), 0)
        .when(F.startswith(low, F.lit("typeerror")) | F.startswith(low, F.lit("referenceerror")), 2)
        .otherwise(3)
    )


def error_severity(users: Column, occurrences: Column, title: Column) -> Column:
    """The worst of users affected, occurrences and the kind of error."""
    return name_of(F.least(impact_rank(users), impact_rank(occurrences), title_rank(title)))


def annotation_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "failure").when(severity == "medium", "warning").otherwise("notice")
