"""Mixing sources to target weights with distributed prefix sums; DataFrame operations only.

Every row gets a uniform hash key, the MD5 of its id as text. Keys order the rows of a source at random but the same way in every
run. Equal-width ranges of the key deal each source over many tasks, so one large source is no hot key; prefix sums run
inside each range and over the ranges' sums. A source's budget is cut where its prefix sum reaches it: whole epochs
first, then the rows before the cut, the last of them in part.

Targets: the total budget is shared by weight; no source gets more than ``limit`` times its size, and what is over is
shared again by weight among the others. This water level is found in closed form: with sources in order of
size / weight, those whose limit lies below the level are full.

Nulls: a null text counts no words and is in the result with taken = 0; null sources are a source of their own, ordered
last; null ids share one hash key. Repeated rows count as often as they stand. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ironsieve.session import cut

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[int], share: tuple[int, int], limit: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source.

    The windows run over the table of sources, which has one row each, never over documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*[F.lit(int(w)) for w in weights])
    placed = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(weight, F.col("place") % len(weights) + 1).cast("long")
    )
    every = W.partitionBy(F.lit(1))
    rising = W.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    onward = rising.rowsBetween(0, W.unboundedFollowing)
    num, den = share
    ranked = (
        placed.withColumn("total", F.sum("source_size").over(every))
        .withColumn("full", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(onward))
        # the level if the sources before this one are full, times den
        .withColumn("above", F.col("total") * num - F.col("full") * (limit * den))
        .withColumn("fills", F.col("above") * F.col("weight") >= F.col("source_size") * F.col("open") * (limit * den))
    )
    level = F.min(F.when(~F.col("fills"), F.struct("place_up", "above", "open"))).over(every)
    ranked = ranked.withColumn("place_up", F.row_number().over(rising)).withColumn("level", level)
    return ranked.select(
        "source",
        "source_size",
        F.when(
            F.col("level").isNull() | (F.col("place_up") < F.col("level.place_up")),
            (F.col("source_size") * limit).cast("double"),
        )
        .otherwise(F.col("weight") * F.col("level.above") / (F.col("level.open") * den))
        .alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    limit: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    ranges: int | None = None,
) -> DataFrame:
    """(id, size, source_size, target, taken, source) for every row of ``docs``.

    ``share``: the budget as a fraction of all sizes; ``ranges``: key ranges per source, by default four for each
    shuffle partition. The result does not depend on it.
    """
    spark = docs.sparkSession
    n = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"))
    )
    # the upper 32 bits of the key, scaled to 0 .. n - 1
    upper = F.conv(F.left("key", F.lit(8)), 16, 10).cast("long")
    sized = sized.withColumn("range", F.shiftright(upper * F.lit(n).cast("long"), 32).cast("int"))
    parts = cut(sized.groupBy("source", "range").agg(F.sum("size").alias("part")))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, share, limit)
    prior = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("part").over(prior), F.lit(0)))
    same = parts["source"].eqNullSafe(targets["source"])
    ranged = parts.join(targets, same).select(parts["source"], "range", "before", "source_size", "target")
    inside = W.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    local = sized.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = local.join(
        ranged, local["source"].eqNullSafe(ranged["source"]) & (local["range"] == ranged["range"])
    ).select("id", local["source"], "size", "source_size", "target", (F.col("before") + F.col("within")).alias("start"))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return joined.select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        (epochs * F.col("size") + last).cast("long").alias("taken"),
        F.col("source").alias("source"),
    )
