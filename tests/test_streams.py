import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ironsieve.operators.events import client_batches
from ironsieve.streaming import errors as st
from ironsieve.streaming.batches import keep_sent, queued


def files(spark, rows, schema, folder, parts):
    """Rows in order over several files, one for each micro-batch."""
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.parquet(f"{folder}/{i}")
    read = spark.readStream.schema(spark.read.parquet(f"{folder}/0").schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false")
    return read.parquet(f"{folder}/*")


def test_sent_batches_equal_the_batch_result(spark, tmp_path):
    r = random.Random(4)
    rows, at = [], 1_700_000_000_000
    for seq in range(400):
        at += r.choice([0, 10, 300, 900])
        rows.append((r.choice("abbbbbbc"), at, seq))
    stream = files(spark, rows, "session_id string, at_ms long, seq long", tmp_path / "in", 4)
    keep_sent(stream, str(tmp_path / "out"), str(tmp_path / "state"), flush_ms=5_000).awaitTermination()
    got = {tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).select("session_id", "batch", "first_seq", "n").collect()}
    df = spark.createDataFrame(rows, "session_id string, at_ms long, seq long")
    want = {tuple(x) for x in client_batches(df, flush_ms=5_000).collect()}
    # what is still in a queue when the stream ends: the last batch of a client, if it isn't full and its tick isn't over
    first, last = {}, {}
    for s, t, q in rows:
        first.setdefault(s, t)
        last[s] = t
    still = set()
    for s in first:
        end = max((w for w in want if w[0] == s), key=lambda w: w[1])
        over = first[s] + ((last[s] - first[s]) // 5_000 + 1) * 5_000
        if end[3] < 10 and over > at:
            still.add(end)
    assert got == want - still and len(got) > 40


def test_groups_are_upserted_in_place(spark, tmp_path):
    rows = [(i, "error", "2024-01-01T00:00:00Z", f"p{i % 2}", ("E", f"m{i % 7}", f"E\n    at f{i % 3} (a.ts:1:1)", False)) for i in range(240)]
    schema = "seq long, type string, timestamp string, project_id string, error struct<name:string,message:string,stack:string,handled:boolean>"
    stream = files(spark, rows, schema, tmp_path / "in", 5)
    st.keep_groups(stream, str(tmp_path / "t"), str(tmp_path / "s"), buckets=3).awaitTermination()
    want = spark.createDataFrame(rows, schema).groupBy("project_id", F.concat(F.lit("E: "), "error.message").alias("t"), "error.stack").count()
    total = st.current_groups(spark, str(tmp_path / "t")).agg(F.sum("occurrences"), F.count(F.lit(1))).first()
    assert (total[0], total[1]) == (240, want.count())
    # one version of each bucket is left
    versions = st._versions(spark, str(tmp_path / "t"))
    assert set(versions) <= {0, 1, 2} and all(len(v) == 1 for v in versions.values())
    folders = [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("bucket=")]
    assert len(folders) <= 3


def test_a_batch_that_failed_is_run_again(spark, tmp_path):
    """A half-written version of a bucket is replaced, and what the batch began with is still there."""
    rows = [(i, "error", "2024-01-01T00:00:00Z", "p", ("E", f"m{i % 5}", None, False)) for i in range(50)]
    schema = "seq long, type string, timestamp string, project_id string, error struct<name:string,message:string,stack:string,handled:boolean>"
    table = str(tmp_path / "t")
    st.keep_groups(files(spark, rows, schema, tmp_path / "in", 1), table, str(tmp_path / "s"), buckets=2).awaitTermination()
    before = st._versions(spark, table)
    bucket = sorted(before)[0]
    # as a crash leaves it: the next batch's version of a bucket, without most of its rows
    spark.read.parquet(f"{table}/bucket={bucket}/version={before[bucket][0]}").limit(1).write.parquet(f"{table}/bucket={bucket}/version=1")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    again = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in/0")).schema).parquet(str(tmp_path / "in/*"))
    st.keep_groups(again, table, str(tmp_path / "s"), buckets=2).awaitTermination()
    assert st.current_groups(spark, table).agg(F.sum("occurrences"), F.count(F.lit(1))).first()[:] == (100, 5)


def test_a_clients_events_are_batched_at_once():
    r = random.Random(5)
    for _ in range(200):
        ticks = sorted(r.choices(range(6), k=r.randrange(1, 40)))
        want, n = [], 0
        for i, t in enumerate(ticks):
            n = 1 if i == 0 or t != ticks[i - 1] or n == 3 else n + 1
            if n == 1:
                want.append([i, 0])
            want[-1][1] += 1
        begin, sizes = queued(np.array(ticks), 3)
        assert [list(x) for x in zip(begin.tolist(), sizes.tolist(), strict=True)] == want


def test_clients_share_rows_of_state(spark, tmp_path):
    r = random.Random(6)
    rows, at = [], 1_700_000_000_000
    for seq in range(1500):
        at += r.choice([0, 10, 30, 90])
        rows.append((r.choice([None, "hot", "hot", "hot", *(f"c{i}" for i in range(60))]), at, seq))
    rows.insert(700, ("hot", None, 5000))  # no time, no tick
    stream = files(spark, rows, "session_id string, at_ms long, seq long", tmp_path / "in", 4)
    q = keep_sent(stream, str(tmp_path / "out"), str(tmp_path / "state"), flush_ms=2_000, buckets=5)
    q.awaitTermination()
    assert 0 < max(p.stateOperators[0].numRowsTotal for p in q.recentProgress) <= 5
    got = [tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).select("session_id", "batch", "first_seq", "n").collect()]
    timed = [x for x in rows if x[1] is not None]
    df = spark.createDataFrame([(s or "~", t, q) for s, t, q in timed], "session_id string, at_ms long, seq long")
    want = {(None if s == "~" else s, b, f, n) for s, b, f, n in client_batches(df, flush_ms=2_000).collect()}
    first, last = {}, {}
    for s, t, _ in timed:
        first.setdefault(s, t)
        last[s] = t
    final = {s: max((w for w in want if w[0] == s), key=lambda w: w[1]) for s in first}
    still = {w for s, w in final.items() if w[3] < 10 and first[s] + ((last[s] - first[s]) // 2_000 + 1) * 2_000 > at}
    assert len(got) == len(set(got)) and set(got) == want - still and still and len(got) > 500


def test_a_client_that_comes_back_late_is_new(spark, tmp_path):
    rows = [("a", 1_000, 0), ("b", 1_000, 1), ("b", 101_000, 2), ("b", 101_000, 3), ("b", 201_000, 4), ("b", 201_000, 5), ("a", 301_000, 6), ("b", 301_000, 7), ("b", 401_000, 8), ("b", 401_000, 9)]
    for idle, number in ((50_000, 0), (None, 1)):
        base = tmp_path / str(idle)
        stream = files(spark, rows, "session_id string, at_ms long, seq long", base / "in", 5)
        keep_sent(stream, str(base / "out"), str(base / "state"), flush_ms=5_000, idle_ms=idle, buckets=1).awaitTermination()
        got = spark.read.parquet(str(base / "out")).where("session_id = 'a'").select("batch", "first_seq", "n").collect()
        assert sorted(map(tuple, got)) == [(0, 0, 1), (number, 6, 1)]
