"""N-gram Jaccard self-join: hash blocks bring near copies together, signature trees link them.

The corpus-wide pruning is done by shared hashes (steps 1 to 3), which is what makes the join a few shuffles; inside the
groups that they leave, all links are found by the dual traversal of signature trees (step 4).

1. Of every document's shingles in hash order, so many first ones are listed that two similar documents share a fifth of
   their size among them (the prefix filter, with a share instead of one). A document of which fewer listed shingles
   stand in any other document has no partner and drops out; that leaves little besides near copies.
2. Documents with equal sets are one class; of each class only the smallest id goes on.
3. What is left is grouped. A set is split by hash range into so many parts that two similar sets, which differ in few
   shingles, have several equal parts (pigeonhole over the size of the symmetric difference); the number of parts goes by
   classes of size, and a set near an end of its class is in a scheme with the neighbouring class, too. Empty parts are
   left out where the others suffice by the same count. Sets with an equal part meet at its centre, one of them; a set
   may leave its rarest centres as long as it leaves fewer than half of the parts that it must share, as two similar
   sets then still meet. So passages that many documents share join little. Outside of a group there is no link.
4. The classes of a group meet in one task, where signature trees find its links (see signature_tree). A group beyond
   the block size is dealt over blocks within bands of similar size. First every block is searched alone, together with
   a few pivots of its band and of the band below; in a group of near copies that joins all blocks at once. Only the
   sets outside of the group's largest component so far, its stragglers, then meet the blocks of their own and the
   neighbouring bands: of two sets that are joined already no link is missed. Tasks return edges that span the
   components, not all pairs.
5. Connected components over these edges.

Equal shingles are combined inside each batch before the shuffle, and the centres of parts by partial aggregation, so a
shingle or part that a third of all documents hold is no hot key; the centres of frequent parts are broadcast
(``join_by_key``).

Links are decided on the whole sets, so none is lost or added at any size (shingles are 64-bit hashes). Nulls: a null
text or one without words has an empty set and links with nothing; a null id gets no component and links with nothing.
Ids are integers, or texts of such (others are an error).
Rows that repeat an id are one vertex. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ironsieve.llm.signature_tree import linked_pairs
from ironsieve.llm.textvec import mix, portions, row_words, shingles
from ironsieve.operators.components import connected_components, hot_bar, join_by_key
from ironsieve.session import cut, release

#: A class of sizes ends at so many times its start.
CLASS = 1.4
#: Shingles and documents of a block at most, about.
BLOCK_SHINGLES, BLOCK_DOCS = 1 << 20, 4096
#: Up to so many rows that say where a document goes may be broadcast to its text.
BROADCAST_IDS = 200_000
#: Hash ranges of listed shingles for each shuffle partition: small ones, so that a range is a small group.
RANGES = 8
_MARK = np.uint64(1)


def flat_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and elements, joined, of the sets of all texts."""
    sets = shingle_sets(texts, k)
    return np.array([len(x) for x in sets], np.int64), np.concatenate([*sets, np.empty(0, np.uint64)])


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    h, at = row_words(texts)
    s, to = shingles(h, at, k)
    return [np.unique(s[to[i] : to[i + 1]]) for i in range(len(texts))]


def size_classes(percent: int) -> np.ndarray:
    """The upper ends of the classes of size: similar sets are in the same class or in neighbouring ones."""
    ends = [1]
    while ends[-1] < 1 << 31:
        ends.append(max(ends[-1] + 1, int(ends[-1] * CLASS), 100 * ends[-1] // percent))
    return np.array(ends, np.int64)


def schemes(percent: int) -> np.ndarray:
    """For each scheme, in how many elements two similar sets of it can differ.

    Scheme 2c is for pairs inside class c; 2c + 1 for those of a set at the end of class c and one at the start of c + 1.
    """
    ends = size_classes(percent)
    past = np.minimum(np.append(ends[1:], ends[-1]), 100 * ends // percent)
    both = np.stack([2 * ends, ends + past], axis=1).ravel()
    return both * (100 - percent) // (100 + percent)


def part_keys(n: np.ndarray, flat: np.ndarray, scheme: np.ndarray, percent: int):
    """(rows, keys, need) of the parts of sets under their schemes; n, flat: sizes and sorted elements of the sets.

    A key's lowest seven bits are its scheme. ``need``: so many keys a set has in common with every similar one, at least.
    """
    differ = schemes(percent)[scheme]
    parts = (differ + 1) * 3 // 2 + 1
    parts[differ == 0] = 1
    row = np.repeat(np.arange(len(n)), n)
    base = np.cumsum(parts) - parts
    own = base[row] + ((flat >> np.uint64(32)) * parts[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    count = np.bincount(own, minlength=int(parts.sum()))
    edge = np.concatenate([[0], np.cumsum(count)])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ np.uint64(0x5BD1E995)))])
    who = np.repeat(np.arange(len(n)), parts)
    number = np.arange(len(who)) - base[who]
    class_ = scheme.astype(np.uint64)[who]
    salt = mix((class_ << np.uint64(44)) + number.astype(np.uint64))
    key = (mix((total[edge[1:]] - total[edge[:-1]]) ^ salt) & ~np.uint64(127)) | class_
    empty = count == 0
    lacking = np.bincount(who[empty], minlength=len(n))
    all_ = lacking >= parts - differ
    keep = ~empty | all_[who]
    return who[keep], key[keep], np.where(all_, 1, parts - differ - lacking)


def _placed(n: np.ndarray, flat: np.ndarray, percent: int):
    """(rows, sizes, scheme, elements): all sets in their class, then those near its end, then those near its start."""
    ends = size_classes(percent)
    c = np.searchsorted(ends, n)
    yield np.arange(len(n)), n, 2 * c, flat
    last = np.where(c > 0, ends[c - 1], 0)
    for near, scheme in ((100 * n >= percent * (ends[c] + 1), 2 * c + 1), (percent * n <= 100 * last, 2 * c - 1)):
        at = np.flatnonzero(near)
        if len(at):
            yield at, n[at], scheme[at], flat[np.repeat(near, n)]


def set_hashes(n: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of every non-empty set."""
    start = np.cumsum(n) - n
    h1 = np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5)), start).view(np.int64)
    return h1, np.add.reduceat(mix(flat + np.uint64(0x1234567)), start).view(np.int64)


def _describe(k: int):
    """A document's id, set size and 128-bit set hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in portions(batch.column(1)):
                n, flat = flat_sets(texts, k)
                some = np.flatnonzero(n)
                h1, h2 = np.zeros((2, len(texts)), np.int64)
                if len(some):
                    h1[some], h2[some] = set_hashes(n[some], flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), *map(pa.array, (n, h1, h2))], ["id", "n", "h1", "h2"]
                )

    return run


def listed(n, percent: int):
    """How many of n shingles are listed: similar sets share a fifth of the smaller size, at least, among theirs."""
    return n - -(-percent * n // 100) + -(-n // 5)


def least_shared(n: Column, percent: int) -> Column:
    """So many listed shingles a set of n shares with every similar one, at least: a partner has percent of its size."""
    return F.ceil(F.ceil(n * percent / F.lit(100)) / F.lit(5))


def _meeting(key: np.ndarray, node: np.ndarray):
    """Distinct (key, node) sorted, and the starts and sizes of the groups of equal keys; a key's lowest bit is a mark."""
    plain = key & ~_MARK
    order = np.lexsort((~key & _MARK, node, plain))
    key, node, plain = key[order], node[order], plain[order]
    new = np.concatenate([[True], (plain[1:] != plain[:-1]) | (node[1:] != node[:-1])])
    key, node, plain = key[new], node[new], plain[new]
    start = np.flatnonzero(np.concatenate([[True], plain[1:] != plain[:-1]]))
    size = np.diff(np.append(start, len(plain)))
    return key, node, start, size


def _list(k: int, percent: int, ranges: int):
    """Listed shingles by hash range, one row for each in a batch, and how many each set shares inside the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            valid = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            tokens, nodes = [], []
            for at, texts in portions(batch.column(1)):
                n, flat = flat_sets([t if valid[at + i] else None for i, t in enumerate(texts)], k)
                n = n[n > 0]
                if len(n):
                    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
                    first = place < np.repeat(listed(n, percent), n)
                    tokens.append(flat[first])
                    nodes.append(np.repeat(set_hashes(n, flat)[0], n)[first])
            if not tokens:
                continue
            t = np.concatenate(tokens) << np.uint64(1)  # the lowest bit: shared inside the batch
            t, node, start, size = _meeting(t, np.concatenate(nodes))
            who, c = np.unique(node[np.repeat(size > 1, size)], return_counts=True)
            t, node = t[start] | (size > 1).astype(np.uint64), node[start]
            r = ((t >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            edge = np.searchsorted(r, np.arange(ranges + 1))
            used = np.flatnonzero(edge[1:] > edge[:-1])
            blobs = [t[edge[q] : edge[q + 1]].tobytes() + node[edge[q] : edge[q + 1]].tobytes() for q in used]
            counts = [b""] * len(used)
            counts[number % len(used)] = who.tobytes() + c.astype(np.int64).tobytes()
            yield pa.RecordBatch.from_pydict({"r": pa.array(used, pa.int32()), "blob": blobs, "links": counts})

    return run


def _shared_counts(table: pa.Table) -> pa.Table:
    """(a, c): how many of a range's listed shingles each set shares with others."""
    t, node = np.concatenate([np.frombuffer(x.as_py(), np.int64).reshape(2, -1) for x in table["blob"]], axis=1)
    t, node, _, size = _meeting(t.view(np.uint64), node)
    new = np.repeat(size > 1, size) & (t & _MARK == 0)
    known = [np.frombuffer(x.as_py(), np.int64).reshape(2, -1) for x in table["links"]]
    a, c = np.concatenate([np.array([node[new], np.ones(new.sum(), np.int64)]), *known], axis=1)
    who, at = np.unique(a, return_inverse=True)
    return pa.table({"a": who, "c": np.bincount(at, c, len(who)).astype(np.int64)})


def _parts(k: int, percent: int):
    """(a, key) of every set's parts, and (a, scheme, need) as rows without key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "key", "s", "need"]
        for batch in batches:
            for _, texts in portions(batch.column(1)):
                n, flat = flat_sets(texts, k)
                n = n[n > 0]
                if not len(n):
                    continue
                h1, _ = set_hashes(n, flat)
                for rows, size, scheme, elements in _placed(n, flat, percent):
                    row, key, need = part_keys(size, elements, scheme, percent)
                    none = pa.nulls(len(row), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(h1[rows[row]]), pa.array(key.view(np.int64)), none, none], names)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h1[rows]), pa.nulls(len(rows), pa.int64()), pa.array(scheme.astype(np.int32)), pa.array(need.astype(np.int32))], names
                    )

    return run


def _trees(k: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("id", "ascending")])
        ids, side, part = (table[c].to_numpy() for c in ("id", "side", "part"))
        sets = []
        for _, texts in portions(table["text"].combine_chunks()):
            sets += shingle_sets(texts, k)
        filled = np.array([len(s) > 0 for s in sets])
        a, b = [], []
        if table["cross"][0].as_py():
            left, right = np.flatnonzero(filled & (side == 0)), np.flatnonzero(filled & (side == 1))
            found = linked_pairs(sets, left, right, percent) if len(left) and len(right) else []
        else:
            found = []
            edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                own = np.arange(s, e)[filled[s:e]]
                base = [sets[i] for i in own]
                found += [(own[x], own[y]) for x, y in linked_pairs(base, np.arange(len(own)), None, percent)]
        a, b = ids[[x for x, _ in found]], ids[[y for _, y in found]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


#: Members of a band that every block of it and of the band above is searched with.
PIVOTS = 4


def _key(c, g, x, i, j):
    return F.struct(c.alias("c"), g.cast("int").alias("g"), F.lit(x).alias("x"), i.cast("int").alias("i"), j.cast("int").alias("j"))


def _numbers(count):
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def _small_keys(member: DataFrame, of: DataFrame, partitions: int) -> DataFrame:
    """(id, part, key, cross, side): the task where each class representative of a small group meets its group."""
    total = of.agg(F.sum("tokens")).first()[0] or 0
    tasks = max(1, math.ceil(total / BLOCK_SHINGLES), 2 * partitions)
    c = F.col("component")
    key = _key(F.lit(-1).cast("long"), F.lit(0), 0, F.pmod(F.xxhash64(c), F.lit(tasks)), F.lit(0))
    return member.join(of.select(c), "component").select("id", c.alias("part"), key.alias("key"), F.lit(False).alias("cross"), F.lit(0).alias("side"))


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks that the sets of each (component, band g) need."""
    need = F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count(F.lit(1)) / BLOCK_DOCS)).cast("int")
    return rows.groupBy("component", "g").agg(need.alias("blocks"))


def _own_keys(large: DataFrame) -> DataFrame:
    """Keys of every member's own block, and of the pivots in the other blocks of their band and the band above."""
    c, g = F.col("component"), F.col("g")
    own = large.select("id", c.alias("part"), _key(c, g, 0, F.col("t"), F.col("t")).alias("key"))
    pivots = large.groupBy("component", "g").agg(*(F.min_by("id", F.xxhash64("id", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)))
    pivots = pivots.select("component", "g", F.explode(F.array_distinct(F.array(*(f"p{k}" for k in range(PIVOTS))))).alias("id"))
    blocks = large.select("component", "g", "blocks").distinct()
    placed = pivots.join(large.select("id", "t"), "id")
    met = placed.withColumn("up", F.explode(F.array(F.lit(0), F.lit(1)))).select("component", (g + F.col("up")).alias("g"), "id", "t", "up")
    met = met.join(blocks, ["component", "g"]).withColumn("o", F.explode(_numbers(F.col("blocks")))).where("up = 1 or o <> t")
    met = met.select("id", c.alias("part"), _key(c, g, 0, F.col("o"), F.col("o")).alias("key"))
    return own.unionByName(met).select("*", F.lit(False).alias("cross"), F.lit(0).alias("side"))


def _straggler_keys(large: DataFrame, parts: DataFrame) -> DataFrame:
    """Keys where the sets outside of their group's largest component meet all blocks of sets of similar size."""
    rooted = large.join(parts.select(F.col("node").alias("id"), F.col("component").alias("root")), "id", "left")
    rooted = cut(rooted.withColumn("root", F.coalesce("root", "id")))
    first = rooted.groupBy("component", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("component").agg(F.max_by("root", F.struct("k", "root")).alias("first"))
    apart = cut(rooted.join(first, "component").where("root <> first").drop("first", "root", "blocks", "t"))
    few = _blocks(apart).withColumnRenamed("blocks", "some")
    side = lambda rows, band, d, i, j, which: rows.select(
        "id", F.col("component").alias("part"), _key(F.col("component"), band, d + 2, i, j).alias("key"), F.lit(True).alias("cross"), F.lit(which).alias("side")
    )
    blocks = large.select("component", "g", "blocks").distinct()
    apart = apart.join(few, ["component", "g"]).withColumn("s", F.pmod(F.xxhash64("id"), F.col("some")).cast("int"))
    out = None
    g, o = F.col("g"), F.col("o")
    for d in (-1, 0, 1):  # the stragglers' band is the block's and d
        held = large.join(few.withColumn("g", g - d), ["component", "g"]).withColumn("o", F.explode(_numbers(F.col("some"))))
        sent = apart.join(blocks.withColumn("g", g + d), ["component", "g"]).withColumn("o", F.explode(_numbers(F.col("blocks"))))
        both = side(held, g, d, F.col("t"), o, 0).unionByName(side(sent, g - d, d, o, F.col("s"), 1))
        out = both if out is None else out.unionByName(both)
    return out


def group_links(docs: DataFrame, member: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): edges that span the components of the link graph inside the groups of ``member`` (id, n, component)."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of = member.groupBy("component").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    of = cut(of.where("docs > 1"))
    big = (F.col("tokens") > BLOCK_SHINGLES) | (F.col("docs") > BLOCK_DOCS)

    def search(keys: DataFrame) -> DataFrame:
        return cut(_texts_of(docs, keys).groupBy("key").applyInArrow(_trees(k, percent), "a long, b long"))

    small = _small_keys(member, of.where(~big), partitions)
    if of.where(big).isEmpty():
        return search(cut(small))
    g = F.floor(F.log("n") / F.lit(math.log(100 / percent))).cast("int") if percent < 100 else F.lit(0)
    large = cut(member.join(of.where(big).select("component"), "component").withColumn("g", g))
    large = cut(large.join(_blocks(large), ["component", "g"]).withColumn("t", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    found = search(cut(small.unionByName(_own_keys(large))))
    release(docs.sparkSession)
    return found.unionAll(search(cut(_straggler_keys(large, connected_components(found)))))


def _texts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (id, ...) with their texts: few rows are broadcast, many are joined."""
    if rows.count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(rows), "id")
    return docs.join(rows.select("id").distinct(), "id", "left_semi").join(rows, "id")


def stars(links: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b): edges with the components of ``links``: each a and its b's hang on the smallest of these b's.

    Sets of one group meet at the same few centres, so the edges between centres are few distinct ones and every set has
    one edge of its own, where ``links`` has one for each part. An a has a b for each part of its set, at most.
    """
    met = links.groupBy(a).agg(F.collect_set(b).alias("bs")).select(a, "bs", F.array_min("bs").alias("m"))
    ends = met.select(F.explode(F.array_append("bs", F.col(a))).alias("a"), F.col("m").alias("b"))
    return ends.where("a != b").distinct()


def jaccard_components(
    docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``."""
    if not 0 < percent <= 100 or not 0 < k <= 64:
        raise ValueError("percent must be in 1..100 and k in 1..64")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    blobs = "r int, blob binary, links binary"
    sets = cut(docs.mapInArrow(_describe(k), "id long, n long, h1 long, h2 long"))
    filled = sets.where("n > 0 and id is not null")
    reps = cut(filled.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("f")))
    more = reps.where("f > 1").select("n", "h1", "h2", "rep", "f")
    same = join_by_key(filled, more, ["n", "h1", "h2"], "f", hot_bar(filled.count())).where("id != rep")
    copies = cut(same.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    shared = docs.mapInArrow(_list(k, percent, ranges), blobs).groupBy("r").applyInArrow(_shared_counts, "a long, c long")
    shared = shared.groupBy("a").agg(F.sum("c").alias("c"))
    near = reps.withColumnRenamed("h1", "a").join(shared, "a").where(F.col("c") >= least_shared(F.col("n"), percent))
    near = cut(near.select("a", "n", F.col("rep").alias("id")))
    del shared, reps, filled, same, more
    release(spark)
    parts = cut(_texts_of(docs, near.select("id")).mapInArrow(_parts(k, percent), "a long, key long, s int, need int"))
    keyed = parts.where("key is not null").select("a", "key")
    centres = keyed.groupBy("key").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("f")).where("f > 1")
    met = join_by_key(keyed, centres, ["key"], "f", hot_bar(keyed.count())).groupBy("a", F.col("key").bitwiseAND(127).cast("int").alias("s"), "b")
    met = cut(met.agg(F.count(F.lit(1)).alias("c")))
    needs = parts.where("key is null").select("a", "s", "need").distinct()
    alive = needs.join(met.groupBy("a", "s").agg(F.sum("c").alias("c")), ["a", "s"]).where("c >= need")
    alive = cut(alive.select("a", "s", "need"))
    rarest = W.partitionBy("a", "s").orderBy("c", "b").rowsBetween(W.unboundedPreceding, 0)  # a row for each part, at most
    kept = met.join(alive, ["a", "s"]).withColumn("sum", F.sum("c").over(rarest)).where("2 * sum >= need")
    groups = connected_components(stars(kept, "a", "b"))
    member = near.join(alive.select("a").distinct(), "a").join(groups.withColumnRenamed("node", "a"), "a")
    member = cut(member.select("id", "n", "component"))
    del groups, kept, met, alive, needs, keyed, centres, parts
    release(spark)
    parts = connected_components(group_links(docs, member, k, percent).unionAll(copies))
    return sets.join(parts.withColumnRenamed("node", "id"), "id", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )
