"""Production events: grouping, severity, lists, status, routing and limits, in batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ironsieve.functions import severity as sev
from ironsieve.functions import text as tx

KINDS = ("error", "performance", "api_error")
#: What a later write of a group replaces; everything else keeps its first value.
UPDATED = ("severity", "users_affected", "occurrences", "last_seen", "status", "root_cause", "suggested_fix")


def group_errors(events: DataFrame) -> DataFrame:
    """One row for each group (project, name, message, first frame) of error events (see schemas.EVENT).

    Arrival order is ``seq``: first_seen and last_seen are those of the first and last arrival, not the least and
    greatest time. Users affected are the occurrences, as the service counts them. Groups are formed on the raw fields.
    """
    e = events.where("type = 'error'").select(
        "seq",
        "project_id",
        F.col("timestamp"),
        F.coalesce("error.name", F.lit("")).alias("name"),
        F.coalesce("error.message", F.lit("")).alias("message"),
        F.col("error.stack").alias("stack"),
    )
    e = e.withColumn("frame", tx.first_frame(F.col("stack")))
    g = e.groupBy("project_id", "name", "message", "frame").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.min_by("timestamp", "seq").alias("first_seen"),
        F.max_by("timestamp", "seq").alias("last_seen"),
        F.min_by(F.coalesce("stack", F.lit("")), "seq").alias("stack_trace"),
    )
    return describe_groups(g)


def describe_groups(g: DataFrame, status: Column | None = None) -> DataFrame:
    """Grouped rows as stored groups (see schemas.ERROR_GROUP)."""
    title = F.concat("name", F.lit(": "), "message")
    key = F.concat_ws("::", "project_id", "name", "message", "frame")
    place = tx.file_and_line(F.col("stack_trace"))
    return g.select(
        F.left(F.sha2(key, 256), F.lit(16)).alias("id"),
        "project_id",
        sev.error_severity(F.col("occurrences"), F.col("occurrences"), title).alias("severity"),
        title.alias("title"),
        place["file"].alias("file"),
        place["line"].alias("line"),
        tx.root_cause(F.col("name"), F.col("message"), F.col("stack_trace")).alias("root_cause"),
        tx.suggested_fix(F.col("name"), F.col("message")).alias("suggested_fix"),
        F.col("occurrences").alias("users_affected"),
        "occurrences",
        "first_seen",
        "last_seen",
        (F.lit("open") if status is None else status).alias("status"),
        "stack_trace",
    )


def list_errors(groups: DataFrame, status: str | None = "open", severity: str | None = None) -> DataFrame:
    """By severity, then latest first; status ``all`` or None shows every status."""
    if status not in (None, "all"):
        groups = groups.where(F.col("status") == status)
    if severity:
        groups = groups.where(F.col("severity") == severity)
    return groups.orderBy(sev.rank(F.col("severity"), 99), F.desc("last_seen"), "id")


def error_status(groups: DataFrame, now: Column) -> DataFrame:
    """Whether a group is resolved or recurring, and how sure that is."""
    hours = (F.unix_micros(now) - F.unix_micros(F.to_timestamp("last_seen"))) / F.lit(3_600_000_000.0)
    resolved = F.col("status") == "resolved"
    sure = F.when(resolved, F.least(hours / 24, F.lit(1.0))).otherwise(F.least(F.col("occurrences") / 10, F.lit(1.0)))
    return groups.select(
        "id",
        F.when(resolved, "resolved").otherwise("recurring").alias("status"),
        F.col("last_seen").alias("last_occurrence"),
        hours.alias("hours_since_last"),
        sure.alias("confidence"),
    )


def resolve(groups: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    done = groups.join(hit, "id", "left")
    return done.withColumn("status", F.when(F.col("_hit"), "resolved").otherwise(F.col("status"))).drop("_hit")


def upsert(stored: DataFrame, new: DataFrame, key: str = "id", updated=UPDATED) -> DataFrame:
    """Rows of both by key: where both have one, ``updated`` columns are the new ones and the rest the stored ones."""
    n = new.select(*[F.col(c).alias(f"_{c}") for c in new.columns])
    both = stored.join(n, stored[key] == F.col(f"_{key}"), "full_outer")
    return both.select(
        *[
            (F.coalesce(F.col(f"_{c}"), F.col(c)) if c in updated else F.coalesce(F.col(c), F.col(f"_{c}"))).alias(c)
            for c in stored.columns
        ]
    )


def latest_wins(rows: DataFrame, key: list[str], order: str, kept: list[str] = ()) -> DataFrame:
    """One row for each key: the last values in order, but the first ones of ``kept``."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(*[(F.min_by if c in kept else F.max_by)(c, order).alias(c) for c in rest])


def newest(rows: DataFrame, limit: int | None = None, time: str = "timestamp", tie: str = "id") -> DataFrame:
    out = rows.orderBy(F.desc(time), tie)
    return out if limit is None else out.limit(limit)


def ingest_counts(events: DataFrame) -> DataFrame:
    """One row: everything sent is accepted; only known kinds are processed."""
    return events.agg(
        F.count(F.lit(1)).alias("accepted"), F.count_if(F.col("type").isin(*KINDS)).alias("processed")
    )


def route(events: DataFrame) -> dict[str, DataFrame]:
    return {kind: events.where(F.col("type") == kind) for kind in KINDS}


def assigned(events: DataFrame, header: Column, body: Column) -> DataFrame:
    """The request's project, by header before body, on every event; requests without one are refused."""
    return events.withColumn("project_id", F.coalesce(header, body)).where("project_id is not null and project_id != ''")


def sampled(events: DataFrame, rate: float, key: str = "seq", special: float | None = None) -> DataFrame:
    """A reproducible share of the events, with a rate of its own for performance events."""
    share = F.conv(F.left(F.md5(F.col(key).cast("string")), F.lit(8)), 16, 10).cast("long") / F.lit(float(1 << 32))
    limit = F.lit(rate) if special is None else F.when(F.col("type") == "performance", special).otherwise(rate)
    return events.where(share < limit)


def before_send(events: DataFrame, hook: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a client's own hook leaves of the events: it may drop rows and rewrite columns, not add or lose any column."""
    out = hook(events)
    if set(out.columns) != set(events.columns):
        raise ValueError("the hook must return the events' columns")
    return out.select(*events.columns)


def client_batches(events: DataFrame, size: int = 10, by: str = "session_id", flush_ms: int | None = None, time: str = "at_ms") -> DataFrame:
    """(by, batch, first_seq, n): a client's events in the batches of its queue, sent when ``size`` are in it and, with
    ``flush_ms``, at every tick of a clock that starts with the client's first event."""
    tick = F.lit(0).cast("long")
    if flush_ms:
        first = events.groupBy(by).agg(F.min(time).alias("_first"))
        events = events.join(first, by)
        tick = F.floor((F.col(time) - F.col("_first")) / flush_ms)
    rows = events.withColumn("_tick", tick)
    n = F.row_number().over(W.partitionBy(by, "_tick").orderBy("seq")) - 1
    sent = rows.withColumn("_part", F.floor(n / size)).groupBy(by, "_tick", "_part").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"))
    batch = F.row_number().over(W.partitionBy(by).orderBy("_tick", "_part")) - 1
    return sent.select(by, batch.cast("long").alias("batch"), "first_seq", "n")


def window_ends(at: np.ndarray, reset: int, window_ms: int) -> tuple[np.ndarray, list[int]]:
    """For sorted times the number of the window of each (0: the one that is open until ``reset``), and the windows'
    ends from then on. Windows are found one by one, times inside them all at once."""
    ends, starts, place = [reset], [], int(np.searchsorted(at, reset))
    while place < len(at):
        starts.append(place)
        ends.append(int(at[place]) + window_ms)
        place = int(np.searchsorted(at, ends[-1]))
    return np.searchsorted(np.array(starts, np.int64), np.arange(len(at)), side="right"), ends


def enrich_new(groups: DataFrame, stored: DataFrame, maps: DataFrame) -> DataFrame:
    """New groups (id, project_id, release, file, ...): not stored yet. Those with a release get the ``source`` of their
    file's map, the others none."""
    new = groups.join(stored.select("id"), "id", "left_anti")
    with_release = resolved_frames(new.where("release is not null"), maps)
    return with_release.unionByName(new.where("release is null").withColumn("source", F.lit(None).cast("string")))


def resolved_frames(errors: DataFrame, maps: DataFrame) -> DataFrame:
    """Errors with ``source``: the first source outside of installed packages in the map of their file, if there is one.

    maps: (project_id, release, file_path, content); a file's map is ``file.map``, else one under its own name.
    """
    schema = "sources array<string>"
    own = F.get(F.filter(F.from_json("content", schema)["sources"], lambda s: ~F.contains(s, F.lit("node_modules"))), F.lit(0))
    m = maps.select("project_id", "release", "file_path", own.alias("source"))
    a = m.select("project_id", "release", F.regexp_replace("file_path", r"\.map$", "").alias("file"), F.col("source").alias("_map")).where(F.endswith(maps["file_path"], F.lit(".map")))
    b = m.select("project_id", "release", F.col("file_path").alias("file"), F.col("source").alias("_same"))
    on = ["project_id", "release", "file"]
    return errors.join(a, on, "left").join(b, on, "left").withColumn("source", F.coalesce("_map", "_same", "file")).drop("_map", "_same")
