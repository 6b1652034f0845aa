"""A client's event queue over a stream: sent when it is full, and at every tick of the client's clock.

State is the open queues of clients, which Spark keeps and hands over with their new events. Clients share a row of state
by the hash of their name, as a call for each of them costs more than the work; their events are cut into batches all at
once. An event-time timeout flushes a queue when its tick ends, and a client that has sent everything is forgotten after
``idle_ms`` without events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Rows of state; with some hundred clients in each, a client costs little. A checkpoint keeps to its number.
BUCKETS = 1024
SENT = "session_id string, batch long, first_seq long, n long"
# of each client its name, when its clock began, its open tick, the number of batches sent, the time of its last event and
# how many events are in its queue; and the queues, one after the other
QUEUES = "sessions array<string>, first array<long>, tick array<long>, sent array<long>, last array<long>, held array<long>, seqs array<long>"


def queued(ticks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the batches of events in order begin, and how many events each has: a batch holds up to ``size`` of one tick.
    Ticks that follow each other differ."""
    starts = np.flatnonzero(np.diff(ticks, prepend=ticks[:1] - 1))
    place = np.arange(len(ticks)) - np.repeat(starts, np.diff(starts, append=len(ticks)))
    begin = np.flatnonzero(place % size == 0)
    return begin, np.diff(begin, append=len(ticks))


def _clients(size: int, flush_ms: int, idle_ms: int | None) -> Callable:
    """Rows (session_id, at_ms, seq) of the clients of one row of state to the batches that they send (SENT)."""

    def fold(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        old, *kept = state.get if state.exists else ([],) * 7
        first, tick, sent, last, held, waiting = (np.array(x, np.int64) for x in kept)
        rows = [] if state.hasTimedOut else [(p["session_id"].to_numpy(), p["at_ms"].to_numpy(), p["seq"].to_numpy()) for p in parts]
        names, at, seq = (np.concatenate([np.empty(0, t), *x]) for t, x in zip((object, np.int64, np.int64), zip(*rows, strict=True) if rows else ((),) * 3, strict=True))
        code, sessions = pd.factorize(np.concatenate([np.array(old, object), names]), use_na_sentinel=False)
        code, new = code[len(old) :], len(sessions) - len(old)
        first = np.concatenate([first, np.full(new, np.iinfo(np.int64).max)])
        known = code < len(old)
        np.minimum.at(first, code[~known], at[~known])
        tick, sent, held, last = (np.concatenate([x, np.zeros(new, np.int64)]) for x in (tick, sent, held, last))
        last[len(old) :] = first[len(old) :]
        np.maximum.at(last, code, at)

        own = (at - first[code]) // flush_ms
        order = np.lexsort((seq, own))
        # each client's queue, then its new events; what comes after its tick's end joins the open queue
        who = np.concatenate([np.repeat(np.arange(len(sessions)), held), code[order]])
        ticks = np.concatenate([np.repeat(tick, held), np.maximum(own, tick[code])[order]])
        place = np.argsort(who, kind="stable")
        who, ticks, every = who[place], ticks[place], np.concatenate([waiting, seq[order]])[place]
        begin, n = queued(np.cumsum((np.diff(who, prepend=-1) != 0) | (np.diff(ticks, prepend=-1) != 0)), size)
        who, ticks = who[begin], ticks[begin]
        final = np.diff(who, append=-1) != 0  # a client's last batch
        tick[who[final]] = ticks[final]
        still = final & (n < size) & (first[who] + (ticks + 1) * flush_ms > now)
        number = sent[who] + np.arange(len(who)) - np.searchsorted(who, who)
        out = pd.DataFrame({"session_id": sessions[who], "batch": number, "first_seq": np.minimum.reduceat(every, begin) if len(begin) else every, "n": n})[~still]

        sent += np.bincount(who[~still], minlength=len(sessions))
        held = np.zeros(len(sessions), np.int64)
        held[who[still]] = n[still]
        due = np.where(held > 0, first + (tick + 1) * flush_ms, np.iinfo(np.int64).max if idle_ms is None else last + (idle_ms or 0))
        stay = due > now
        if stay.any():
            names = [None if pd.isna(x) else x for x in sessions[stay]]
            state.update((names, *(x[stay].tolist() for x in (first, tick, sent, last, held)), every[np.repeat(still, n)].tolist()))
            if (least := int(due[stay].min())) < np.iinfo(np.int64).max:
                state.setTimeoutTimestamp(max(least - 1, 1))  # it is over when the watermark is past it
        elif state.exists:
            state.remove()
        if len(out):
            yield out

    return fold


def sent_batches(events: DataFrame, size: int = 10, flush_ms: int = 5_000, idle_ms: int | None = None, late_ms: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """SENT of a stream of events (session_id, at_ms, seq), as ``operators.events.client_batches`` has them in batch.

    A clock starts with a client's first event and ticks every ``flush_ms``; events up to ``late_ms`` behind the stream
    are waited for, those without a time are left out. A micro-batch's events of the clients in one of ``buckets`` are
    sorted in one task. With ``idle_ms`` a client that comes back after so long is a new one.
    """
    timed = events.where("at_ms is not null").select("session_id", "at_ms", "seq", F.timestamp_millis("at_ms").alias("at")).withWatermark("at", f"{late_ms} milliseconds")
    dealt = timed.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)))
    fold = _clients(size, flush_ms, idle_ms)
    return dealt.groupBy("bucket").applyInPandasWithState(fold, SENT, QUEUES, "append", GroupStateTimeout.EventTimeTimeout)


def use_rocks(spark: SparkSession) -> None:
    """A state store that needn't hold all clients' queues in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def keep_sent(events: DataFrame, table: str, checkpoint: str, size: int = 10, flush_ms: int = 5_000, idle_ms: int | None = None, buckets: int = BUCKETS, **trigger) -> object:
    """Append what clients send to a table."""
    use_rocks(events.sparkSession)
    sent = sent_batches(events, size, flush_ms, idle_ms, buckets=buckets)
    return sent.writeStream.outputMode("append").format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
