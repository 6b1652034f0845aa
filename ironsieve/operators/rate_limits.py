"""Fixed windows that start with the first request after the last one's end, found without passing requests in order.

Where windows lie depends on every request before. But each moment with a request has one successor: the first moment
with a request that is a window's length later, found by an as-of join. Windows start at the moments that successors
reach from a project's first one, and doubling finds these: with jumps over 1, 2, 4, … windows, each round doubles the
starts that are known. Nothing is held for a whole project, so one project with all requests is spread like any other.

Projects of up to ``IN_ORDER`` requests, which one task passes in a moment, go in order instead, many to a task; their
task is bounded by that number. The results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ironsieve.operators.events import window_ends
from ironsieve.operators.prefix import carried, running_sums
from ironsieve.session import cut

IN_ORDER = 1_000_000
LIMITED = "project_id string, at_ms long, seq long, allowed boolean, remaining long, reset_ms long"


def window_starts(moments: DataFrame, window_ms: int, ranges: int | None = None) -> DataFrame:
    """(project_id, at_ms): where windows start, of distinct moments (project_id, at_ms) with requests."""
    probe = moments.select("project_id", F.col("at_ms").alias("of"), (F.col("at_ms") + window_ms).alias("t"), F.lit(1).alias("probe"))
    there = moments.select("project_id", F.lit(None).cast("long").alias("of"), F.col("at_ms").alias("t"), F.lit(0).alias("probe"))
    # backwards in time, so that what is carried is the nearest moment at or after
    back = probe.unionAll(there).withColumn("back", -F.col("t"))
    met = carried(back, ["project_id"], ["back", "probe", "of"], {"next": F.when(F.col("probe") == 0, F.col("t"))}, ranges)
    jumps = cut(met.where("probe = 1 and next is not null").select("project_id", F.col("of").alias("at_ms"), "next"))
    starts = cut(moments.groupBy("project_id").agg(F.min("at_ms").alias("at_ms")))
    known, n = starts.count(), 0
    while known > n:  # each round doubles how many windows of a project are known
        n = known
        reached = starts.join(jumps, ["project_id", "at_ms"]).select("project_id", F.col("next").alias("at_ms"))
        starts = cut(starts.unionAll(reached).distinct())
        known = starts.count()
        if known > n:
            on = jumps.select("project_id", F.col("at_ms").alias("next"), F.col("next").alias("_far"))
            jumps = cut(jumps.join(on, ["project_id", "next"]).select("project_id", "at_ms", F.col("_far").alias("next")))
    return starts


def _in_order(rows: DataFrame, window_ms: int) -> DataFrame:
    """LIMITED of (project_id, at_ms, seq, most), each project in order in one task; only its open window is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, reset, count = None, 0, 0
        for b in batches:
            for p, own in b.groupby("project_id", sort=False):
                at = own["at_ms"].to_numpy()
                if p != open_:
                    # a window that ended before the first request
                    open_, reset, count = p, int(at[0]), 0
                number, ends = window_ends(at, reset, window_ms)
                first = np.searchsorted(number, number)  # where each row's window begins in the batch
                n = np.arange(len(at)) - first + 1 + np.where(number == 0, count, 0)
                left = own["most"].to_numpy() - n
                count = int(n[-1])
                reset = ends[-1]
                yield own[["project_id", "at_ms", "seq"]].assign(allowed=left >= 0, remaining=np.maximum(left, 0), reset_ms=np.array(ends)[number])

    return rows.repartition("project_id").sortWithinPartitions("project_id", "at_ms", "seq").mapInPandas(run, LIMITED)


def rate_limited(requests: DataFrame, most: int = 1000, window_ms: int = 60_000, ranges: int | None = None, in_order: int = IN_ORDER) -> DataFrame:
    """Requests (project_id, at_ms, seq) with allowed, remaining and reset_ms.

    Refused requests count. Where routes have limits of their own but share the counter, a column ``most`` says each
    request's limit. A null project is "anonymous"; requests without a time are left out; repeated rows count each.
    """
    limit = (F.col("most") if "most" in requests.columns else F.lit(most)).cast("long").alias("most")
    rows = requests.where(F.col("at_ms").isNotNull()).select(F.coalesce("project_id", F.lit("anonymous")).alias("project_id"), F.col("at_ms").cast("long"), F.col("seq").cast("long").alias("seq"), limit)
    sizes = rows.groupBy("project_id").count().where(F.col("count") > in_order).select("project_id")
    large = [r[0] for r in sizes.collect()]  # at most one for each ``in_order`` requests
    small = _in_order(rows if not large else rows.where(~F.col("project_id").isin(large)), window_ms)
    if not large:
        return small
    rows = cut(rows.where(F.col("project_id").isin(large)))
    starts = window_starts(rows.select("project_id", "at_ms").distinct(), window_ms, ranges)
    marks = starts.select("project_id", "at_ms", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("most"), F.lit(0).alias("is_row"))
    both = marks.unionAll(rows.select("project_id", "at_ms", F.col("seq").cast("long"), "most", F.lit(1).alias("is_row")))
    met = carried(both, ["project_id"], ["at_ms", "is_row", "seq"], {"start": F.when(F.col("is_row") == 0, F.col("at_ms"))}, ranges)
    counted = running_sums(met.where("is_row = 1").drop("is_row"), ["project_id", "start"], ["at_ms", "seq"], {"n": F.lit(1).cast("long")}, ranges)
    left = F.col("most") - F.col("n")
    spread = counted.select("project_id", "at_ms", "seq", (left >= 0).alias("allowed"), F.greatest(left, F.lit(0)).alias("remaining"), (F.col("start") + window_ms).alias("reset_ms"))
    return spread.unionByName(small)
