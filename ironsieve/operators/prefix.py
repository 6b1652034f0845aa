"""Running sums, places and carried values inside of keys without a task per key: ranges of the order, and sums over the
ranges."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ironsieve.session import cut


def _over_ranges(rows: DataFrame, by: Sequence[str], order: Sequence[str], values: Mapping[str, Column], fold: Callable[[str], Column], join: Callable[[str, str], Column], ranges: int | None) -> DataFrame:
    """``rows`` with, for each name of ``values``, ``fold`` of its values over the rows of the same key up to this one.

    Rows are dealt over ranges of (``by``, ``order``), so a key with most of the rows spans many tasks. Each range is
    folded by itself, and what the ranges before hold of the same key is joined to it. At most one key goes on from one
    range into the next, so the table of what is joined has a row for each range at most, and is broadcast.
    """
    keys = [*by, *order]
    valued = rows.withColumns({f"_v_{name}": value for name, value in values.items()})
    dealt = valued.repartitionByRange(ranges, *keys) if ranges else valued.repartitionByRange(*keys)
    dealt = cut(dealt).withColumn("_range", F.spark_partition_id())
    inside = W.partitionBy("_range", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = dealt.withColumns({name: fold(f"_v_{name}").over(inside) for name in values})
    whole_range = W.partitionBy("_range", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = dealt.withColumns({f"_e_{name}": fold(f"_v_{name}").over(whole_range) for name in values}).select("_range", *by, *(f"_e_{name}" for name in values))
    whole = ends.groupBy("_range", *by).agg(*(F.any_value(f"_e_{name}").alias(f"_v_{name}") for name in values))
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    prior = whole.select(
        F.col("_range").alias("_r"),
        *(F.col(c).alias(f"_k_{i}") for i, c in enumerate(by)),
        F.count(F.lit(1)).over(before).alias("_earlier"),
        *(fold(f"_v_{name}").over(before).alias(f"_b_{name}") for name in values),
    ).where("_earlier > 0")
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & local[c].eqNullSafe(F.col(f"_k_{i}"))
    met = local.join(F.broadcast(prior), same, "left")
    return met.select(*rows.columns, *(join(f"_b_{name}", name).alias(name) for name in values))


def running_sums(rows: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, Column], ranges: int | None = None) -> DataFrame:
    """``rows`` with, for each name of ``sums``, the sum of its expression over the rows of the same key up to this one.

    Ascending, nulls first; rows equal in ``by`` and ``order`` share a range and follow each other in no stated order:
    give an ``order`` that tells rows apart where that matters. Null keys are a key; an empty table gives no rows.
    """
    return _over_ranges(rows, by, order, sums, F.sum, lambda b, x: F.coalesce(x, F.lit(0)) + F.coalesce(b, F.lit(0)), ranges)


def carried(rows: DataFrame, by: Sequence[str], order: Sequence[str], values: Mapping[str, Column], ranges: int | None = None) -> DataFrame:
    """``rows`` with, for each name of ``values``, its last value that isn't null among the rows of the same key up to
    this one: an as-of join once both sides are in ``rows``. Order, keys and ties as in ``running_sums``."""
    return _over_ranges(rows, by, order, values, lambda c: F.last(c, ignorenulls=True), lambda b, x: F.coalesce(x, b), ranges)


def places(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "place", ranges: int | None = None) -> DataFrame:
    """``rows`` with the place of each inside of its key, from 1."""
    return running_sums(rows, by, order, {name: F.lit(1).cast("long")}, ranges)
