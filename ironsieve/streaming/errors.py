"""Error groups, routing and rate limits over streams of events.

State is kept per key by Spark: error groups as a running aggregation whose changes are upserted by ``foreachBatch``,
rate limits as keyed state. Arrival order is the events' ``seq``; micro-batches do not keep order across partitions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ironsieve.functions.text import first_frame
from ironsieve.operators.events import KINDS, describe_groups, resolved_frames, window_ends
from ironsieve.session import cut, delete_folder, ensure_checkpoint_dir
from ironsieve.streaming.batches import keep_sent


def read_events(spark: SparkSession, folder: str, files: str = "*.parquet", per_trigger: int = 8) -> DataFrame:
    """A stream of the parquet files in a folder, with their schema."""
    schema = spark.read.option("pathGlobFilter", files).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def running_groups(events: DataFrame) -> DataFrame:
    """The running state of every error group; use with output mode ``update``."""
    e = events.where("type = 'error'").select(
        "seq",
        "project_id",
        "timestamp",
        F.coalesce("error.name", F.lit("")).alias("name"),
        F.coalesce("error.message", F.lit("")).alias("message"),
        F.coalesce("error.stack", F.lit("")).alias("stack"),
        first_frame(F.col("error.stack")).alias("frame"),
    )
    return e.groupBy("project_id", "name", "message", "frame").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.min(F.struct("seq", "timestamp", "stack")).alias("first"),
        F.max(F.struct("seq", "timestamp")).alias("last"),
    )


GROUP_KEY = ("project_id", "name", "message", "frame")


def keep_groups(events: DataFrame, table: str, checkpoint: str, buckets: int = 16, **trigger) -> object:
    """Upsert every change of a group into ``table``, in place: groups lie in buckets by the hash of their key, and a
    batch rewrites the buckets that it changes.

    A bucket's new version is written beside the one that is there, which goes when the batch is done; so a batch that
    fails and is run again finds what it began with, and the table holds each group once, or twice while a batch runs.
    """
    spark = events.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        changed = cut(batch.withColumn("bucket", F.pmod(F.xxhash64(*GROUP_KEY), F.lit(buckets)).cast("int")))
        old = _versions(spark, table, number)
        touched = {r.bucket for r in changed.select("bucket").distinct().collect()}
        gone = [(b, v) for b, vs in old.items() for v in vs if b in touched]
        rows = changed
        if gone:
            last = spark.read.schema(changed.drop("bucket").schema).parquet(*(f"{table}/bucket={b}/version={max(old[b])}" for b in sorted({b for b, _ in gone})))
            kept = last.join(changed.select(*GROUP_KEY), [*GROUP_KEY], "left_anti")
            rows = changed.unionByName(kept.withColumn("bucket", F.pmod(F.xxhash64(*GROUP_KEY), F.lit(buckets)).cast("int")))
        dealt = rows.withColumn("version", F.lit(number)).repartition("bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(table)
        for b, v in gone:
            delete_folder(spark, f"{table}/bucket={b}/version={v}")

    writer = running_groups(events).writeStream.outputMode("update").foreachBatch(put)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _versions(spark: SparkSession, table: str, before: int | None = None) -> dict[int, list[int]]:
    """The versions of each bucket, those of batches before ``before`` only."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/bucket=*/version=*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    out: dict[int, list[int]] = {}
    for f in found:
        b, v = (int(x.split("=")[1]) for x in f.getPath().toString().split("/")[-2:])
        if before is None or v < before:
            out.setdefault(b, []).append(v)
    return out


def current_groups(spark: SparkSession, table: str, resolved: DataFrame | None = None) -> DataFrame:
    """The stored groups (see schemas.ERROR_GROUP). Groups listed in ``resolved`` (id, at_seq) stay resolved when they
    recur, and ``recurred`` says whether they did."""
    last = [f"{table}/bucket={b}/version={max(v)}" for b, v in sorted(_versions(spark, table).items())]
    key = ["project_id", "name", "message", "frame"]
    g = spark.read.parquet(*last).select(*key, "occurrences", F.col("first.timestamp").alias("first_seen"), F.col("last.timestamp").alias("last_seen"), F.col("first.stack").alias("stack_trace"), F.col("last.seq").alias("last_seq"))
    out = describe_groups(g)
    if resolved is None:
        return out
    id_ = F.left(F.sha2(F.concat_ws("::", *key), 256), F.lit(16))
    seen = g.select(id_.alias("id"), "last_seq").join(resolved, "id").select("id", (F.col("last_seq") > F.col("at_seq")).alias("recurred"))
    return out.join(seen, "id", "left").withColumn("status", F.when(F.col("recurred").isNotNull(), "resolved").otherwise(F.col("status")))


def keep_routed(events: DataFrame, base: str, checkpoint: str, **trigger) -> object:
    """Append each known kind of event to a table of its own under ``base``; other kinds are dropped."""

    def put(batch: DataFrame, number: int) -> None:
        known = batch.where(F.col("type").isin(*KINDS)).withColumn("kind", F.col("type"))
        known.write.mode("overwrite").partitionBy("kind").parquet(f"{base}/batch={number}")

    writer = events.writeStream.foreachBatch(put)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def limit_stream(requests: DataFrame, most: int = 1000, window_ms: int = 60_000) -> DataFrame:
    """(project_id, at_ms, allowed, remaining, reset_ms) of a stream of requests (project_id, at_ms, seq), with a
    project's open window as state. Inside a micro-batch order is that of time, then ``seq``."""

    def fold(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["at_ms", "seq"], kind="stable")
        at = rows["at_ms"].to_numpy()
        reset, count = state.get if state.exists else (int(at[0]), 0)
        number, ends = window_ends(at, reset, window_ms)
        n = np.arange(len(at)) - np.searchsorted(number, number) + 1 + np.where(number == 0, count, 0)
        state.update((ends[-1], int(n[-1])))
        yield pd.DataFrame({"project_id": key[0], "at_ms": at, "allowed": n <= most, "remaining": np.maximum(most - n, 0), "reset_ms": np.array(ends)[number]})

    project = F.coalesce("project_id", F.lit("anonymous")).alias("project_id")
    return requests.select(project, "at_ms", "seq").groupBy("project_id").applyInPandasWithState(
        fold,
        "project_id string, at_ms long, allowed boolean, remaining long, reset_ms long",
        "reset long, count long",
        "update",
        GroupStateTimeout.NoTimeout,
    )


def enriched(groups: DataFrame, maps: DataFrame) -> DataFrame:
    """A stream of new groups (project_id, release, file, ...) joined with the stored source maps, a static table."""
    return resolved_frames(groups, maps)


def limit_once(spark: SparkSession, sf_dir: str, shape: Callable[[DataFrame], DataFrame], most: int, window_ms: int) -> DataFrame:
    """All requests of a data folder through the limiter."""
    table, state = _folders(spark)
    limited = limit_stream(shape(_table_stream(spark, sf_dir)), most, window_ms)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    limited.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(table).drop("batch")


def batches_once(spark: SparkSession, sf_dir: str, shape: Callable[[DataFrame], DataFrame], flush_ms: int) -> DataFrame:
    """All events of a data folder through the clients' queues."""
    table, state = _folders(spark)
    keep_sent(shape(_table_stream(spark, sf_dir)), table, state, flush_ms=flush_ms).awaitTermination()
    return spark.read.parquet(table)


def _folders(spark: SparkSession) -> tuple[str, str]:
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/table", f"{base}/state"


def run_once(spark: SparkSession, sf_dir: str, shape: Callable[[DataFrame], DataFrame], resolved: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All events of a data folder through the stream, then the groups it has kept; ``resolved`` makes the list of
    resolved groups (id, at_seq) from them."""
    table, state = _folders(spark)
    keep_groups(shape(_table_stream(spark, sf_dir)), table, state).awaitTermination()
    groups = current_groups(spark, table)
    return current_groups(spark, table, resolved(groups)) if resolved else groups


def route_once(spark: SparkSession, sf_dir: str, shape: Callable[[DataFrame], DataFrame]) -> DataFrame:
    table, state = _folders(spark)
    keep_routed(shape(_table_stream(spark, sf_dir)), table, state).awaitTermination()
    return spark.read.parquet(table)


def _table_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # as a pattern the path may name a file or a folder of files
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
