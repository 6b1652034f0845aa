"""Embedding near-duplicates: int8 tile products with rigorous error bounds.

Vectors are compared only inside their label (and dimension). Equal vectors are one class with a count. Every class's
unit vector is rounded once to int8 with a step of its own; a second int8 holds what that rounding left, in 254ths of
the step. Only these bytes are dealt over tiles of bounded size, and every pair of tiles is one small task: the
tile product of the first int8 rows is exact, and each vector's rounding error norm e bounds what was lost:
|x.y - x'.y'| <= |x'| e_y + |y'| e_x + e_x e_y. A pair whose product minus bound reaches the threshold is a link, one
whose product plus bound does not is none; between, the second bytes decide under their own, some hundred times
smaller bound. The few pairs still open come back as ids, and only for them are the full vectors fetched and multiplied
in double precision, so the links are those of double precision, none lost or added. A tile pair returns one row for
each vector with links (how many, and the smallest member of its part of the tile pair) and the open pairs.

All tiles of a label are compared, so the work grows with the square of the largest label; a vector is copied, in two
bytes a component, once for each tile of its label.

Nulls: a vector that is null, empty, zero, or holds a null or non-finite component links with nothing, as does one
without label or id. Ids are integers (or texts of such). Rows that repeat an id are one vertex; each counts as a
vector. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ironsieve.operators.components import connected_components
from ironsieve.session import cut

#: Bytes of a tile, about (tiles are dealt by hash).
TILE_BYTES = 1 << 21
_CHUNK = 1 << 21
_FINE = 254


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, safe for very large and very small components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


@dataclass
class Codes:
    """int8 rows, what their rounding left as int8 in 254ths of the step, steps, the norms of the rounded rows and of
    what the first and both roundings lost (norms rounded up a little)."""

    first: np.ndarray
    second: np.ndarray
    step: np.ndarray
    norm: np.ndarray
    lost: np.ndarray
    least: np.ndarray

    def __getitem__(self, rows) -> Codes:
        return Codes(self.first[rows], self.second[rows], self.step[rows], self.norm[rows], self.lost[rows], self.least[rows])

    def fine(self, rows: np.ndarray) -> np.ndarray:
        return (self.first[rows] + self.second[rows] / _FINE) * self.step[rows, None]


def quantise(u: np.ndarray) -> Codes:
    step = np.abs(u).max(axis=1) / 127
    scaled = u / step[:, None]
    first = np.rint(scaled).astype(np.int8)
    second = np.rint((scaled - first) * _FINE).astype(np.int8)
    rough = first * step[:, None]
    fine = (first + second / _FINE) * step[:, None]
    up = lambda x: np.sqrt((x**2).sum(axis=1)) * (1 + 1e-12) + 1e-15
    return Codes(first, second, step, up(rough), up(u - rough), up(u - fine))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows: single-precision sums stay below 2^24 for 1,024 components at a time."""
    out = a[:, :1024].astype(np.float32) @ b[:, :1024].astype(np.float32).T
    if a.shape[1] > 1024:
        out = out.astype(float)
        for at in range(1024, a.shape[1], 1024):
            out += a[:, at : at + 1024].astype(np.float32) @ b[:, at : at + 1024].astype(np.float32).T
    return out


def tile_links(u: Codes, v: Codes | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, sure) arrays of the pairs of two tiles that are links or may be; v None: inside one tile, each pair once."""
    same, v = v is None, u if v is None else v
    rows = max(1, _CHUNK // max(1, len(v.step)))
    slack = 2e-6  # more than what single precision loses of a cosine
    for at in range(0, len(u.step), rows):
        part = u[at : at + rows]
        near = _product(part.first, v.first)
        near *= part.step.astype(near.dtype)[:, None]
        near *= v.step.astype(near.dtype)[None, :]
        near += np.outer(part.norm, v.lost).astype(near.dtype)
        near += np.outer(part.lost, v.norm + v.lost).astype(near.dtype)
        i, j = np.nonzero(near >= threshold - slack)
        if same:
            keep = i + at < j
            i, j = i[keep], j[keep]
        bound = part.norm[i] * v.lost[j] + part.lost[i] * (v.norm[j] + v.lost[j])
        sure = near[i, j] - 2 * bound >= threshold + slack
        open_ = np.flatnonzero(~sure)
        drop = np.zeros(len(i), bool)
        for c in np.array_split(open_, 1 + len(open_) * u.first.shape[1] // (8 * _CHUNK)):
            dot = np.einsum("ij,ij->i", part.fine(i[c]), v.fine(j[c]))
            lost, other = part.least[i[c]], v.least[j[c]]
            bound = (1 + lost) * other + (1 + other) * lost + lost * other + 1e-12
            sure[c] = dot - bound >= threshold
            drop[c] = dot + bound < threshold
        yield i[~drop] + at, j[~drop], sure[~drop]


class Sets:
    """Union-find over 0..n-1 whose root is the smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


_CODES = "label string, dim int, id long, copies long, first binary, second binary, step double, norm double, lost double, least double"


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The codes of every class, dimension by dimension."""
    names = [x.split()[0] for x in _CODES.split(", ")]
    for b in batches:
        dims = b.column(1).to_numpy()
        for dim in np.unique(dims):
            own = b.filter(pa.array(dims == dim))
            c = quantise(unit_rows(own.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)))
            packed = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (c.first, c.second)]
            yield pa.RecordBatch.from_arrays([*own.columns[:4], *packed, *map(pa.array, (c.step, c.norm, c.lost, c.least))], names)


def _codes(table: pa.Table) -> Codes:
    first, second = (np.frombuffer(b"".join(table[x].to_pylist()), np.int8).reshape(table.num_rows, -1) for x in ("first", "second"))
    return Codes(first, second, *(table[x].to_numpy() for x in ("step", "norm", "lost", "least")))


def _pair_task(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("id", "ascending")])
        side, ids, copies = (table[x].to_numpy() for x in ("side", "id", "copies"))
        cut_at = int((side == 0).sum())
        lone = table["lone"][0].as_py()
        if not lone and cut_at in (0, len(ids)):
            none = pa.array([], pa.int64())
            return pa.table({"id": none, "links": none, "root": none, "other": none})
        links = np.zeros(len(ids), np.int64)
        # each vector's smallest partner by rank; ranks follow ids
        rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        by_rank = np.argsort(rank)
        sets = Sets(len(ids))
        u, a, b = _codes(table), [], []
        for i, j, sure in tile_links(u, None, threshold) if lone else tile_links(u[:cut_at], u[cut_at:], threshold):
            j = j if lone else j + cut_at
            a.append(ids[i[~sure]])
            b.append(ids[j[~sure]])
            i, j = i[sure], j[sure]
            links += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
            # a chunk of n pairs joins at most as many sets as it has rows: settle by labels, then join what is new
            while len(i):
                label = np.array([sets.root(k) for k in range(len(ids))])
                new = label[rank[i]] != label[rank[j]]
                i, j = i[new], j[new]
                if not len(i):
                    break
                _, one = np.unique(np.maximum(label[rank[i]], label[rank[j]]), return_index=True)
                for x, y in zip(rank[i[one]], rank[j[one]], strict=True):
                    sets.join(int(x), int(y))
        first = ids[by_rank[[sets.root(int(k)) for k in rank]]]
        some = links > 0
        a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (a, b))
        return pa.table(
            {
                "id": pa.array(np.concatenate([ids[some], a])),
                "links": pa.concat_arrays([pa.array(links[some]), pa.nulls(len(a), pa.int64())]),
                "root": pa.concat_arrays([pa.array(first[some]), pa.nulls(len(a), pa.int64())]),
                "other": pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(b)]),
            }
        )

    return run


def _exact(threshold: float):
    """Open pairs (a, b, copies of both, both vectors) that are links in double precision, as rows like a tile pair's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, many_a, many_b = (batch.column(k).to_numpy() for k in range(4))
            x, y = (batch.column(k).to_pylist() for k in (4, 5))
            link = np.array([unit_rows(np.array([p]))[0] @ unit_rows(np.array([q]))[0] >= threshold for p, q in zip(x, y, strict=True)], bool)
            a, b, many_a, many_b = a[link], b[link], many_a[link], many_b[link]
            yield pa.RecordBatch.from_pydict(
                {"id": np.concatenate([a, b]), "links": np.concatenate([many_b, many_a]), "root": np.concatenate([b, b])}
            )

    return run


def near_duplicate_vectors(
    vectors: DataFrame,
    threshold: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    tile: int | None = None,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``. ``tile``: rows of a tile, by default as many as
    ``TILE_BYTES`` hold."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    raw = F.col(vector_col).cast("array<double>")
    fine = (
        F.col(label_col).isNotNull()
        & F.col(id_col).isNotNull()
        & F.coalesce(F.size(raw) > 0, F.lit(False))
        & F.coalesce(F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)), F.lit(False))
        & F.coalesce(F.exists(raw, lambda x: x != 0), F.lit(False))
    )
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.when(fine, F.col(label_col).cast("string")).alias("label"),
        F.when(fine, raw).alias("vector"),
    )
    classes = cut(
        rows.where("label is not null")
        .groupBy("label", "vector")
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        .withColumn("dim", F.size("vector"))
    )
    coded = classes.select("label", "dim", "rep", "copies", "vector").mapInArrow(_quantised, _CODES)
    rows_of_tile = F.lit(tile) if tile else F.greatest(F.lit(256), F.lit(TILE_BYTES) / (2 * F.col("dim") + 64))
    tiles = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / rows_of_tile).cast("int").alias("n"))
    dealt = coded.join(tiles, ["label", "dim"]).withColumn("t", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    paired = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "label",
        "dim",
        F.least("t", "o").alias("lo"),
        F.greatest("t", "o").alias("hi"),
        (F.col("t") > F.col("o")).cast("int").alias("side"),
        (F.col("t") == F.col("o")).alias("lone"),
        *("id", "copies", "first", "second", "step", "norm", "lost", "least"),
    )
    found = cut(
        paired.groupBy("label", "dim", "lo", "hi").applyInArrow(
            _pair_task(threshold), "id long, links long, root long, other long"
        )
    )
    unsure = found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))
    found = found.where("other is null").drop("other")
    if not unsure.isEmpty():
        full = [classes.select(F.col("rep").alias(x), F.col("copies").alias(f"n{x}"), F.col("vector").alias(f"v{x}")) for x in "ab"]
        both = unsure.join(full[0], "a").join(full[1], "b").select("a", "b", "na", "nb", "va", "vb")
        found = found.unionByName(cut(both.mapInArrow(_exact(threshold), "id long, links long, root long")))
    links = found.groupBy("id").agg(F.sum("links").alias("more"))
    member = rows.join(classes.select("label", "vector", "rep", "copies"), ["label", "vector"], "left").drop("vector")
    member = cut(member.select("id", "rep", "copies"))
    same = member.where(F.col("rep") != F.col("id")).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionAll(same))
    out = member.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(
        parts.withColumnRenamed("node", "id"), "id", "left"
    )
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("more", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
