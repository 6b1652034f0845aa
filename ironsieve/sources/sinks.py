"""Writers: reports, baselines and the event service's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ironsieve.operators import findings as fd


def save_summary(findings: DataFrame, path: str) -> None:
    """One JSON row with counts, score and status of a scan."""
    fd.summary(findings).withColumn("at", F.current_timestamp().cast("string")).write.mode("overwrite").json(path)


def save_baseline(findings: DataFrame, path: str) -> None:
    """Accept the given findings: later scans compare with their fingerprints."""
    fd.fingerprinted(findings).select("id", "file", "line", "type", "hash").write.mode("overwrite").json(path)


def save_report(findings: DataFrame, path: str, order: tuple[str, ...] = ("file", "line")) -> None:
    fd.ordered(findings, *order).write.mode("overwrite").json(path)


def append(rows: DataFrame, path: str, by: str | None = "project_id") -> None:
    """Append to a table, partitioned by project."""
    writer = rows.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def replace_table(rows: DataFrame, path: str, version: str) -> str:
    """Write a whole new version beside the old one and return its path; readers change over when they have the path."""
    to = f"{path}/version={version}"
    rows.write.mode("overwrite").parquet(to)
    return to
