"""The algebra of findings: merge, first-wins, suppress, compare with a baseline, order, grade.

Findings carry their order in columns (``seq`` or several), as Spark rows have none of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ironsieve.functions import severity as sev
from ironsieve.functions.text import finding_hash
from ironsieve.session import cut

DEDUP = ("file", "line", "type", "description")
AUDIT_DEDUP = ("category", "severity", "file", "line", "description")
THREAT_DEDUP = ("id", "location")


def merge(parts: Sequence[DataFrame]) -> DataFrame:
    """The findings of several scanners, in the scanners' order: ``source_no`` goes before their own ``seq``."""
    numbered = [p.withColumn("source_no", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def first_wins(findings: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of equal keys the first row in order; nulls are equal to each other."""
    if len(order) == 1 and len(set(findings.columns)) == len(findings.columns):
        # an aggregate combines copies before the shuffle, so a key with very many copies is no hot key
        row = F.struct(F.col(order[0]).alias("_first"), *[F.col(c) for c in findings.columns])
        best = findings.groupBy(*key).agg(F.min_by(row, F.col(order[0])).alias("row"))
        return best.select(*[F.col("row")[c].alias(c) for c in findings.columns])
    w = W.partitionBy(*key).orderBy(*order)
    return findings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def scored(findings: DataFrame) -> DataFrame:
    """Findings that count for the score: neither informational nor in example environments."""
    return findings.where((F.col("severity") != "info") & ~F.col("context").eqNullSafe(F.lit("env-example")))


def grade(worst: Column) -> Column:
    return F.when(worst.isNull(), "A").when(worst == 0, "F").when(worst == 1, "D").when(worst == 2, "C").otherwise("B")


def summary(findings: DataFrame) -> DataFrame:
    """One row: counts by severity, auto-fixable count, score and status, also for no findings."""
    counts = (F.col("severity") != "info") & ~F.col("context").eqNullSafe(F.lit("env-example"))
    every = findings.agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in sev.RANKS],
        F.count_if(F.coalesce(F.col("auto_fixable"), F.lit(False))).alias("auto_fixable"),
        F.coalesce(F.bool_or(F.col("severity").isin("critical", "high")), F.lit(False)).alias("_fails"),
        F.min(F.when(counts, sev.rank(F.col("severity")))).alias("_worst"),
    )
    return every.select(
        *sev.RANKS,
        "auto_fixable",
        grade(F.col("_worst")).alias("score"),
        F.when(F.col("_fails"), "fail").otherwise("pass").alias("status"),
    )


def trust(findings: DataFrame) -> DataFrame:
    """One row: the trust grade of an audit, where any malicious finding fails it, and its verdict."""
    return _trusted(findings.agg(*_worst()))


def trust_by(findings: DataFrame, every: DataFrame, by: str = "project") -> DataFrame:
    """The trust grade of each project in ``every``, those without findings too."""
    got = findings.groupBy(by).agg(*_worst())
    whole = every.select(by).distinct().join(got, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _trusted(whole.withColumn("bad", F.coalesce("bad", F.lit(False))), by)


def _worst() -> tuple[Column, ...]:
    bad = F.coalesce(F.bool_or(F.col("category") == "malicious"), F.lit(False))
    return F.count(F.lit(1)).alias("n"), F.min(sev.rank(F.col("severity"))).alias("worst"), bad.alias("bad")


def _trusted(got: DataFrame, *by: str) -> DataFrame:
    worst = F.col("worst")
    mark = (
        F.when(F.col("n") == 0, "A")
        .when(F.col("bad") | (worst == 0), "F")
        .when(worst == 1, "D")
        .when(worst == 2, "C")
        .otherwise("B")
    )
    verdict = F.when(mark.isin("A", "B"), "SAFE").when(mark.isin("C", "D"), "CAUTION").otherwise("DANGEROUS")
    return got.select(*by, mark.alias("grade"), verdict.alias("verdict"))


def running_ids(findings: DataFrame, prefix: str, order: Sequence[str], column: str = "id") -> DataFrame:
    """Findings with running ids ``prefix``1, 2, ... in the given order.

    Rows are dealt by ranges of the order; each range counts its own, and starts after the sum of those before it, of
    which there is one number for each range.
    """
    name = "_part"
    parts = cut(findings.repartitionByRange(*order).withColumn(name, F.spark_partition_id()))
    sizes = parts.groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy(name).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(W.partitionBy(name).orderBy(*order)) + F.col("_before")
    out = parts.join(F.broadcast(sizes.select(name, before.alias("_before"))), name)
    return out.withColumn(column, F.concat(F.lit(prefix), number.cast("string"))).drop(name, "_before")


def whole_scan(
    scanners: Sequence[DataFrame],
    graph: DataFrame | None = None,
    gates: tuple[DataFrame, DataFrame] | None = None,
    kept: Column | None = None,
    changed: DataFrame | None = None,
    baseline: DataFrame | None = None,
) -> DataFrame:
    """The findings of a scan from those of its scanners, in the scanners' order, with their fingerprint as ``hash``.

    Equal findings (``DEDUP``) are the first scanner's; the graph's come after that and are no copies of others. Then
    go: rules that a project's framework makes needless (``gates``: gates and frameworks, for findings with a project),
    paths for which ``kept`` is false, files that did not change, and what the baseline has accepted.
    """
    every = merge(scanners)
    if "project" not in every.columns:
        every = every.withColumn("project", F.lit(""))
    order = F.struct("source_no", "file", "line", F.coalesce("rule_no", F.lit(0)) if "rule_no" in every.columns else F.lit(0), "id")
    out = first_wins(every.withColumn("seq", order), ("project", *DEDUP), ["seq"])
    if graph is not None:
        out = out.unionByName(graph, allowMissingColumns=True)
    if gates is not None:
        out = framework_gated(out, *gates)
    if kept is not None:
        out = out.where(F.coalesce(kept, F.lit(True)))
    if changed is not None:
        out = only_changed(out, changed)
    out = fingerprinted(out)
    return out if baseline is None else not_in_baseline(out, baseline)


def fingerprinted(findings: DataFrame) -> DataFrame:
    return findings.withColumn("hash", finding_hash(F.col("id"), F.col("file"), F.col("description")))


def not_in_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(baseline.select("hash").distinct(), "hash", "left_anti")


def in_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(baseline.select("hash").distinct(), "hash", "left_semi")


def only_changed(findings: DataFrame, changed: DataFrame) -> DataFrame:
    return findings.join(changed.select("file").distinct(), "file", "left_semi")


def ordered(findings: DataFrame, *tie: str) -> DataFrame:
    return findings.orderBy(sev.rank(F.col("severity")), *tie)


def annotations(findings: DataFrame, limit: int = 50, order: Sequence[str] = ("seq",)) -> DataFrame:
    """The first findings in order, as a code host shows them beside the code."""
    top = findings.orderBy(*order).limit(limit)
    return top.select(
        F.col("file").alias("path"),
        F.greatest(F.col("line"), F.lit(1)).alias("start_line"),
        sev.annotation_level(F.col("severity")).alias("annotation_level"),
        F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("type")).alias("title"),
        F.col("description").alias("message"),
    )


def count_text(findings: DataFrame) -> DataFrame:
    """One row: counts as text; severities without findings are left out, informational ones always."""
    got = findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in list(sev.RANKS)[:4]])
    parts = [F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"))) for s in list(sev.RANKS)[:4]]
    return got.select(F.concat_ws(", ", *parts).alias("summary"))


def framework_gated(findings: DataFrame, gates: DataFrame, frameworks: DataFrame) -> DataFrame:
    """Without findings of rules that do not apply to the project's framework: gates (id, framework)."""
    off = frameworks.join(gates, "framework").select("project", "id").distinct()
    return findings.join(off, ["project", "id"], "left_anti")
