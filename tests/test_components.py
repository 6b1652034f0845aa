import random

from pyspark.sql import functions as F

from ironsieve.operators import components
from ironsieve.operators.components import connected_components, hot_bar, join_by_key


def by_hand(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {x: root(x) for x in up}


def test_components_of_hubs_chains_and_noise(spark, monkeypatch):
    r = random.Random(3)
    edges = [(9_999, i) for i in range(400)] + [(1_000 + i, 1_001 + i) for i in range(25)] + [(5_000, 5_000), (None, 3), (7, None)]
    edges += [(r.randrange(20_000, 20_400), r.randrange(20_000, 20_400)) for _ in range(250)] + [(2_000, 3_000 + i) for i in range(300)] * 2
    r.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    want = by_hand(edges)
    for bar in (components.HOT_ROWS, 3):
        monkeypatch.setattr(components, "HOT_ROWS", bar)
        assert {x.node: x.component for x in connected_components(df).collect()} == want
    assert connected_components(df.limit(0)).collect() == []


def test_a_round_over_a_hub_joins_each_edge_three_times_at_most(spark, monkeypatch):
    made, sizes = spark.sparkContext.accumulator(0), []
    join, state = components.join_by_key, components._state

    def counted(rows, *facts):
        def run(batches):
            for x in batches:
                made.add(x.num_rows)
                yield x

        out = join(rows, *facts)
        return out.mapInArrow(run, out.schema)

    def seen(edges):
        out = state(edges)
        sizes.append(out.size if out.open else 0)
        return out

    monkeypatch.setattr(components, "join_by_key", counted)
    monkeypatch.setattr(components, "_state", seen)
    edges = spark.range(1, 1_001).selectExpr("0L AS a", "id AS b").unionAll(spark.range(1, 1_000).selectExpr("id AS a", "id + 1 AS b").where("a % 3 = 0"))
    assert {x.component for x in connected_components(edges).collect()} == {0}
    assert 0 < made.value <= 3 * sum(sizes)


def test_rows_of_a_hot_key_are_dealt_evenly(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") < 60_000, -1).otherwise(F.col("id")).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.max("id").alias("m"), F.count("*").alias("n"))
    out = join_by_key(rows, facts, ["k"], "n", hot_bar(100_000))
    assert out.count() == 100_000 and out.where("k = -1 and m != 59999").count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = join_by_key(rows, facts, ["k"], "n", hot_bar(100_000))
        most = sorted(x[1] for x in out.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(most) == 4 and most[-1] < 1.2 * most[1]
