"""Distributed connected components by alternating star contraction, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ironsieve.session import cut, release

#: A key with more rows than this is met by broadcast; so many such keys there are at most, as the bar rises with the rows.
HOT_ROWS, HOT_KEYS = 200, 50_000


def hot_bar(rows: int) -> int:
    """Rows from which a key is hot: at most ``HOT_KEYS`` of the keys of ``rows`` rows are above it."""
    return max(HOT_ROWS, -(-rows // HOT_KEYS))


def join_by_key(rows: DataFrame, facts: DataFrame, on: list[str], count: str, bar: int) -> DataFrame:
    """``rows`` joined with one fact for each key, where ``count`` (a column of ``facts``) is the key's number of rows.

    Keys above the bar are few (see hot_bar), so their facts are broadcast. Their rows go on with a salt beside the key,
    so the shuffle for the other keys deals them evenly; none of these other keys has more than ``bar`` rows.
    """
    names = [c for c in facts.columns if c not in on and c != count]
    hot = facts.where(F.col(count) > bar).select(*on, F.struct(*names).alias("_hot"))
    cold = facts.where(F.col(count) <= bar).select(*on, (F.col(count) > bar).cast("long").alias("_salt"), F.struct(*names).alias("_cold"))
    salt = F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(*rows.columns))
    met = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", salt).join(cold, [*on, "_salt"], "left")
    fact = F.coalesce("_hot", "_cold")
    return met.where(fact.isNotNull()).select(*rows.columns, *(fact[c].alias(c) for c in names))


def _state(edges: DataFrame) -> Row:
    """(open, most, size): nodes with two parents, or a parent and children (none once every component is one star),
    the largest number of edges at a node, and the edges."""
    seen = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    nodes = seen.groupBy("n").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    open_ = F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))
    return nodes.agg(open_.alias("open"), F.max(F.col("up") + F.col("down")).alias("most"), F.sum("up").alias("size")).first()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    ``edges`` is undirected: loops, repeats, either direction and nulls are fine (a null end drops the edge).
    Every round points larger neighbours at the smallest one (large star), then every node's smaller neighbours at
    the smallest of them (small star). Minima are combined before the shuffle; hubs' minima are few and broadcast
    (``join_by_key``), so no task gets all edges of a hub. Both halves of a round are checkpointed, so the plan
    stays short and the first half, which the second one reads twice, is made once. Rounds grow with the logarithm of the longest chain.
    """
    a, b = F.col(a), F.col(b)
    e = cut(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    while (state := _state(e)).open:
        bar = hot_bar(2 * state.size)

        def meet(rows: DataFrame, facts: DataFrame, bar=bar, hubs=state.most > bar) -> DataFrame:
            return join_by_key(rows, facts, ["u"], "n", bar) if hubs else rows.join(facts, "u")

        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        least = least.select("u", F.least("u", "m").alias("m"), "n")
        large = cut(meet(both, least).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        hung = meet(large, small).where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(hung.unionAll(small.select("u", F.col("m").alias("v"))).distinct())
        if state.most > bar:
            del both, least, large, small, hung, meet
            release(e.sparkSession)  # rounds over hubs leave the most behind
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
