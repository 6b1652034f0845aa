"""Conversation prefix trie by an LCP-aware external mergesort.

A turn is 16 bytes of the SHA-256 of its role and text; a conversation is its turns' bytes in order, in segments of a
fixed number of turns, so that no conversation, however long, is one row. Equal segments below the same node are one
record before anything is sorted. Records are dealt over ranges of their sequences; in each range they become sorted
runs of bounded size that carry LCPs (and store of each sequence only what the one before doesn't share), in blocks that
are checkpointed. A loser tree merges a range's blocks, read in the order of their first keys, and an open-path stack
makes the nodes (see lcp_merge). Nodes on the border of two ranges come out in parts, told by the LCP across the border,
and their parts are added; so subtree sums need no second pass. Conversations longer than a segment go segment by
segment: keys downwards, then subtree sums upwards, one level of the mergesort for each (most tables have one level).

The ids that end in a node are dealt over ranges of (node, id) and become pieces of text there; only these pieces meet
in one task, which hashes them one after another, as SHA-256 is sequential.

Nulls: rows without conversation id are left out; null roles and texts are empty; null turns come first. Rows with equal
turns are in the order of their turn's hash; repeated rows are turns of their own. Ids are integers; for the conversation
whose first turns are taken, ``id % every`` has the sign of the id. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ironsieve.llm.lcp_merge import UNIT, Record, merged, nodes, sorted_run
from ironsieve.operators.components import hot_bar, join_by_key
from ironsieve.operators.prefix import places
from ironsieve.session import cut

WORD = r"[^\x20\x09-\x0D]+"
ROOT = "00" * UNIT
#: Turns of a segment; bytes of a run and of a block of it; bytes of a piece of joined ids.
SEGMENT, RUN, BLOCK, PIECE = 1024, 8 << 20, 32 << 10, 8 << 10
NAMES = ("range", "run", "first", "last", "lcp", "rest", "words", "n", "least", "children", "leaves", "saved")
BLOCKS = "range int, run int, first binary, last binary, lcp array<int>, rest array<binary>, words array<array<long>>, n array<long>, least array<long>, children array<long>, leaves array<long>, saved array<long>"
NODES = "key binary, parent binary, depth long, n_convs long, conv_id long, n_children long, n_leaves long, saved_tokens long, shared boolean"


def _of_schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}

    def kind(s: str) -> pa.DataType:
        return pa.list_(kind(s[6:-1])) if s.startswith("array<") else kinds[s]

    return pa.schema([(name, kind(t)) for name, t in (x.split(" ") for x in ddl.split(", "))])


def turn_symbols(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, symbol, words): a turn's hash as hex digits, and the words of its text."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.left(F.sha2(whole, 256), F.lit(2 * UNIT)).alias("symbol"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )


def rebuilt_segments(turns: DataFrame, every: int, most: int, segment: int) -> DataFrame:
    """(conv_id, seg, digests, words, last): rebuilt conversations in segments; one without turns has an empty one.

    Conversation c takes the first h turns of conversation c - c % every, h = crc32(c) % (most + 1), before its own
    turns after its first h.
    """
    placed = cut(places(turns, ["conv_id"], ["turn", "symbol"]))
    head = F.when(F.col("place") <= most, F.struct("place", "symbol", "words"))
    convs = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(head)).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("long")
    leads = convs.select(F.col("conv_id").alias("lead"), F.col("head").alias("lead_head"))
    convs = convs.withColumns({"h": h, "lead": F.col("conv_id") - F.col("conv_id") % every}).join(leads, "lead", "left")
    taken = F.coalesce(F.filter("lead_head", lambda t: t["place"] <= F.col("h")), F.array())
    convs = cut(convs.withColumn("taken", taken).withColumn("k", F.size("taken").cast("long")))
    total = F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h"))
    facts = convs.select("conv_id", "n", "h", "k", total.alias("total"))
    own = join_by_key(placed, facts, ["conv_id"], "n", hot_bar(placed.count())).where("place > h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("k")).alias("place"), "symbol", "words", "total")
    head = convs.select("conv_id", F.explode("taken").alias("t"), total.alias("total"))
    every_turn = own.unionAll(head.select("conv_id", "t.place", "t.symbol", "t.words", "total"))
    seg = F.floor((F.col("place") - 1) / segment).cast("int")
    parts = every_turn.groupBy("conv_id", seg.alias("seg")).agg(F.sort_array(F.collect_list(F.struct("place", "symbol", "words"))).alias("t"), F.max("total").alias("total"))
    symbols = F.unhex(F.array_join(F.transform("t", lambda t: t["symbol"]), ""))
    last = F.col("seg") == F.floor((F.col("total") - 1) / segment)
    full = parts.select("conv_id", "seg", symbols.alias("digests"), F.transform("t", lambda t: t["words"]).alias("words"), last.alias("last"))
    bare = convs.where(total == 0).selectExpr("conv_id", "0 as seg", "unhex('') as digests", "cast(array() as array<long>) as words", "true as last")
    return cut(full.unionAll(bare))


def _hash(p: Column, digests: Column) -> Column:
    return F.when(F.length(digests) == 0, p).otherwise(F.unhex(F.left(F.sha2(F.concat(p, digests), 256), F.lit(2 * UNIT))))


def _records(batch: pa.RecordBatch) -> Iterator[tuple[int, Record]]:
    columns = (batch.column(c).to_pylist() for c in ("range", "seq", "words", "n", "least", "children", "leaves", "saved"))
    for where, seq, words, n, least, *below in zip(*columns, strict=True):
        yield where, Record(seq, words, n, least, tuple(below))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of about RUN bytes, in blocks of about BLOCK."""
    schema = _of_schema(BLOCKS)

    def blocks(run: int, where: int, records: list[Record]) -> Iterator[pa.RecordBatch]:
        rows, size, before = [], 0, b""
        for lcp, r in sorted_run(records):
            kept = lcp if rows else 0
            rows.append((lcp, r.key[kept * UNIT :], r.weights[max(0, kept - 1) :], r.n, r.least, *r.below))
            size += len(rows[-1][1]) + 8 * len(rows[-1][2]) + 64
            first, before = (r.key if len(rows) == 1 else first), r.key
            if size >= BLOCK:
                yield block(where, run, first, before, rows)
                rows, size = [], 0
        if rows:
            yield block(where, run, first, before, rows)

    def block(*head) -> pa.RecordBatch:
        *head, rows = head
        return pa.RecordBatch.from_pylist([dict(zip(NAMES, [*head, *map(list, zip(*rows, strict=True))], strict=True))], schema=schema)

    held, size, run, where = [], 0, 0, 0
    for batch in batches:
        for where, r in _records(batch):
            held.append(r)
            size += len(r.key) + 8 * len(r.weights) + 200
            if size >= RUN:
                yield from blocks(run, where, held)
                held, size, run = [], 0, run + 1
    yield from blocks(run, where, held)


def _read_blocks(batches: Iterable[pa.RecordBatch], seen: list[int]) -> Iterator[tuple[int, bytes, list[tuple[int, Record]]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            b = batch.slice(i, 1).to_pylist()[0]
            seen[:] = [b["range"]]
            out, key, weights = [], b"", []
            for lcp, rest, words, *more in zip(*(b[c] for c in NAMES[4:]), strict=True):
                kept = lcp if out else 0
                key, weights = key[: kept * UNIT] + rest, weights[: max(0, kept - 1)] + words
                out.append((lcp, Record(key, weights, more[0], more[1], tuple(more[2:]))))
            yield b["run"], b["first"], out


def _merge(batches: Iterable[pa.RecordBatch], borders: dict[int, tuple[int, int]], above: int) -> Iterator[pa.RecordBatch]:
    schema, seen, rows = _of_schema(NODES), [], []
    rest = _read_blocks(batches, seen)
    first = next(rest, None)
    if first is None:
        return

    def again() -> Iterator[tuple[int, bytes, list[tuple[int, Record]]]]:
        yield first
        yield from rest

    for x in nodes(merged(again()), *borders[seen[0]]):
        rows.append((x.key, x.parent, above + x.depth, x.n, x.least, x.children, x.leaves, x.saved, x.shared))
        if len(rows) >= 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _borders(blocks: DataFrame) -> dict[int, tuple[int, int]]:
    """For each range the LCP of its first record with the last before it, and of its last with the first after it."""
    ends = blocks.groupBy("range").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    before = F.lag("last").over(W.orderBy("range"))  # a row for each range
    most = F.floor(F.least(F.length("first"), F.length("before")) / UNIT).cast("int")
    unit = lambda c, i: F.substring(c, i * UNIT + 1, F.lit(UNIT))
    differ = F.array_position(F.transform(F.sequence(F.lit(0), most - 1), lambda i: unit(F.col("first"), i) != unit(F.col("before"), i)), True).cast("int")
    lcp = F.when(F.col("before").isNull(), 0).otherwise(F.when(differ == 0, most).otherwise(differ - 1))
    shared = ends.withColumn("before", before).select("range", lcp.alias("lcp"))
    rows = shared.orderBy("range").collect()
    after = [r.lcp for r in rows[1:]] + [0]
    return {r.range: (r.lcp, n) for r, n in zip(rows, after, strict=False)}


def _level(records: DataFrame, above: int, ranges: int | None) -> DataFrame:
    """Nodes (possibly in parts, see ``shared``) of the tries of records (p, digests, words, n, least, children, leaves, saved)."""
    seq = records.withColumn("seq", F.concat("p", "digests")).drop("p", "digests")
    dealt = seq.repartitionByRange(ranges, "seq") if ranges else seq.repartitionByRange("seq")
    blocks = cut(dealt.withColumn("range", F.spark_partition_id()).mapInArrow(_runs, BLOCKS))
    borders = _borders(blocks)
    return cut(blocks.sortWithinPartitions("range", "first").mapInArrow(lambda b: _merge(b, borders, above), NODES))


def _whole(parts: DataFrame) -> DataFrame:
    """The nodes of ``parts``; those in several are added."""
    sums = [F.first(c).alias(c) for c in ("parent", "depth")] + [F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id")]
    sums += [F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    return parts.where("not shared").drop("shared").unionAll(parts.where("shared").groupBy("key").agg(*sums))


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order, joined by commas, in pieces of about PIECE bytes for each node."""
    schema = _of_schema("key binary, first long, text string")
    node, ids, size, rows = None, [], 0, []
    for batch in batches:
        for key, i in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (key != node or size >= PIECE):
                rows.append((node, ids[0], ",".join(map(str, ids))))
                ids, size = [], 0
            node = key
            ids.append(i)
            size += len(str(i)) + 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            rows = []
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((node, ids[0], ",".join(map(str, ids))), schema.types, strict=True)], schema=schema)


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _of_schema("key binary, ends_sha256 string")
    node, hasher, rows = None, None, []
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if key != node:
                if hasher:
                    rows.append((node, hasher.hexdigest()))
                node, hasher = key, hashlib.sha256(text.encode())
            else:
                hasher.update(b"," + text.encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            rows = []
    if hasher:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([hasher.hexdigest()])], schema=schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the ids (key, conv_id) of each key, ascending, in decimal, joined by commas."""
    dealt = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = dealt.mapInArrow(_pieces, "key binary, first long, text string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key binary, ends_sha256 string")


def conversation_trie(
    conversations: DataFrame,
    every: int = 20,
    most: int = 3,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    segment: int = SEGMENT,
    ranges: int | None = None,
) -> DataFrame:
    """A row for each node: node and parent (hex keys), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. A node's turns are the first ``depth`` of the rebuilt conversation conv_id.

    ``segment`` and ``ranges`` (of sequences; by default Spark's shuffle partitions) don't change the result.
    """
    parts = rebuilt_segments(turn_symbols(conversations, conv_col, turn_col, role_col, text_col), every, most, segment)
    deepest = parts.agg(F.max("seg")).first()[0]
    # keys downwards: where each segment hangs, and where it ends
    levels = []
    for k in range((deepest or 0) + 1):
        here = parts.where(F.col("seg") == k)
        if k:
            here = here.join(levels[-1].where("not last").select("conv_id", F.col("end").alias("p")), "conv_id")
        else:
            here = here.withColumn("p", F.unhex(F.lit(ROOT)))
        here = here.withColumn("end", _hash(F.col("p"), F.col("digests")))
        levels.append(cut(here) if deepest else here)
    # subtree sums upwards
    found, below = None, None
    for k, here in reversed(list(enumerate(levels))):
        records = here.groupBy("p", "end").agg(
            F.first("digests").alias("digests"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")
        )
        zero = {c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")}
        if below is None:
            records = records.withColumns(zero).drop("end")
        else:
            records = records.join(below, "end", "left").withColumns({c: F.coalesce(c, z) for c, z in zero.items()}).drop("end")
        made = _level(records, k * segment, ranges)
        if k:
            below = made.where("parent is null").groupBy(F.col("key").alias("end"))
            below = below.agg(F.sum("n_children").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            made = made.where("parent is not null")
        found = made if found is None else found.unionAll(made)
    whole = cut(_whole(found))
    ends = levels[0].where("last").select(F.col("end").alias("key"), "conv_id")
    for here in levels[1:]:
        ends = ends.unionAll(here.where("last").select(F.col("end").alias("key"), "conv_id"))
    parents = whole.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("of"))
    below_root = join_by_key(whole.where("parent is not null"), parents, ["parent"], "of", hot_bar(whole.count()))
    root = whole.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    told = below_root.unionByName(root).join(end_digests(ends), "key", "left")
    return told.select(
        F.lower(F.hex("key")).alias("node"),
        F.lower(F.hex("parent")).alias("parent"),
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
