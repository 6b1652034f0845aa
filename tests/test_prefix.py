import random

from ironsieve.operators.prefix import places, running_sums
from pyspark.sql import functions as F


def test_running_sums_of_a_hot_key(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), None if i == 7 else i, r.randrange(-5, 9)) for i in range(900)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(5)
    got = running_sums(df, ["k"], ["o"], {"total": F.col("v").cast("long"), "n": F.lit(1)}, ranges=9).collect()
    want, sums = {}, {}
    for k, o, v in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0)):
        total, n = sums.get(k, (0, 0))
        want[o] = sums[k] = (total + v, n + 1)
    assert {x.o: (x.total, x.n) for x in got} == want and len(got) == 900
    assert {x.n for x in places(df.where("k = 'a'"), ["k"], ["o"], "n").collect()} == set(range(1, sum(x[0] == "a" for x in rows) + 1))
    assert running_sums(df.limit(0), ["k"], ["o"], {"total": F.col("v")}).collect() == []
