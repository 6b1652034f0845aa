"""Vector code compression: product codes whose codebooks are searched by ball trees.

A vector is cut into equal consecutive parts, and each part is replaced by the place of its nearest entry in the part's
codebook. Components are integers, floor(scale * x), and so are entries, so distances are exact and results don't depend
on how Spark deals the rows. The first codebooks are the parts of the vectors with the smallest ids. Every round is one
pass over the vectors: tasks look up the nearest entries and add up what each entry has got; only these sums (one row
for each entry and component and task) are shuffled, and only the codebooks, whose size is fixed by ``entries`` and the
vectors' length, come to the driver and go out again.

The search: for each part a ball tree over the entries, an inner ball being cut in the middle of its widest component.
A whole batch of parts first goes down to one leaf each, for a good bound, and then visits every ball that can still
hold an entry as near: a ball is left out only if its distance less its radius is above the bound by more than
rounding can explain, so equal distances are visited too (ties go to the lower place). Entries in visited leaves are
compared by integers.

Nulls: vectors that are null or hold a null or non-finite component are dropped. A vector of another length than that
with the smallest id, or of a length that isn't a multiple of the parts, keeps its row with null code and error. Rows
without an id are coded but never entries; equal ids are entries each, smaller vectors first. With fewer vectors than
entries the codebooks are smaller. Components too large for 64-bit squares are computed as Python integers, and an error
above a long is null. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ironsieve.operators.components import hot_bar, join_by_key
from ironsieve.session import cut

LEAF = 8
SLACK = 1e-9
#: Sums travel as signed digits of this many bits, so that no sum of them leaves a long.
DIGIT = 40
LONG = (1 << 63) - 1


def scaled(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or as Python integers where one is too large for that."""
    x = np.asarray(flat, np.float64)
    with np.errstate(over="ignore"):
        product = np.floor(x * scale)
    if not len(x) or np.abs(product).max() < 2.0**62:
        return product.astype(np.int64)
    # scale is a power of two, so small products are exact; large x have no fraction
    return np.array([int(p) if abs(v) < 2.0**52 else int(v) * scale for v, p in zip(x.tolist(), product.tolist(), strict=True)], object)


def _fits(*parts: np.ndarray) -> bool:
    """Squared distances of these integers, added up over all components, stay in 64 bits."""
    for p in parts:
        if p.dtype == object or p.size and int(np.abs(p).max()) > int((2.0**62 / max(1, p.shape[1])) ** 0.5) // 2:
            return False
    return True


@dataclass
class Ball:
    centre: np.ndarray
    radius: float
    places: np.ndarray | None
    halves: tuple[Ball, Ball] | None


def ball_tree(entries: np.ndarray, places: np.ndarray | None = None) -> Ball:
    """The ball tree over the rows of ``entries``; radii are rounded up."""
    places = np.arange(len(entries)) if places is None else places
    at = entries[places].astype(np.float64)
    centre = at.mean(axis=0)
    size = np.abs(at).max(initial=0.0)
    radius = float(np.sqrt(((at - centre) ** 2).sum(axis=1)).max(initial=0.0)) * (1 + SLACK) + size * SLACK
    if len(places) <= LEAF or not at.shape[1]:
        return Ball(centre, radius, places, None)
    widest = int(np.argmax(at.max(axis=0) - at.min(axis=0)))
    order = places[np.argsort(at[:, widest], kind="stable")]
    middle = len(order) // 2
    return Ball(centre, radius, None, (ball_tree(entries, np.sort(order[:middle])), ball_tree(entries, np.sort(order[middle:]))))


class Nearest:
    """The nearest entry of one part's codebook, ties to the lower place, for many vectors at a time."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.tree = entries, ball_tree(entries)
        self.compared = 0  # entries compared by integers

    def __call__(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, squared distance) of every row of ``parts``."""
        exact = np.int64 if _fits(parts, self.entries) else object
        self._parts, self._entries = parts.astype(exact), self.entries.astype(exact)
        self._real = parts.astype(np.float64)
        self._size = np.abs(self._real).max(axis=1, initial=0.0)
        self._place = np.full(len(parts), len(self.entries), np.int64)
        self._best = np.full(len(parts), np.iinfo(np.int64).max if exact is np.int64 else None, exact)
        everyone = np.arange(len(parts))
        with np.errstate(over="ignore", invalid="ignore"):
            self._descend(self.tree, everyone)
            self._visit(self.tree, everyone)
        return self._place, self._best

    def _distance(self, ball: Ball, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(((self._real[rows] - ball.centre) ** 2).sum(axis=1))

    def _descend(self, ball: Ball, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if ball.halves is None:
            return self._compare(ball, rows)
        left = self._distance(ball.halves[0], rows) <= self._distance(ball.halves[1], rows)
        self._descend(ball.halves[0], rows[left])
        self._descend(ball.halves[1], rows[~left])

    def _visit(self, ball: Ball, rows: np.ndarray) -> None:
        far = self._distance(ball, rows) * (1 - SLACK) - ball.radius - self._size[rows] * SLACK
        reach = np.sqrt(self._best[rows].astype(np.float64)) * (1 + SLACK)
        rows = rows[~(far > reach)]  # what isn't a number is visited
        if not len(rows):
            return
        if ball.halves is None:
            return self._compare(ball, rows)
        for half in ball.halves:
            self._visit(half, rows)

    def _compare(self, ball: Ball, rows: np.ndarray) -> None:
        self.compared += len(rows) * len(ball.places)
        parts, best, place = self._parts[rows], self._best[rows], self._place[rows]
        for k in ball.places.tolist():
            d = ((parts - self._entries[k]) ** 2).sum(axis=1)
            nearer = np.array([b is None or x <= b for x, b in zip(d, best, strict=True)], bool) if d.dtype == object else d <= best
            nearer &= (d != best) | (k < place)
            best[nearer], place[nearer] = d[nearer], k
        self._best[rows], self._place[rows] = best, place


def _slices(batch: pa.RecordBatch, column: str, dim: int, parts: int, scale: int) -> list[np.ndarray]:
    at = batch.column(column)
    x = scaled(at.flatten().to_numpy(zero_copy_only=False), scale).reshape(len(at), dim)
    step = dim // parts
    return [x[:, p * step : (p + 1) * step] for p in range(parts)]


def digits(n: int) -> list[int]:
    """Signed digits of ``n`` to the base 2**DIGIT, lowest first."""
    sign, n, out = (-1 if n < 0 else 1), abs(n), []
    while n:
        out.append(sign * (n & ((1 << DIGIT) - 1)))
        n >>= DIGIT
    return out


def _sums(batches: Iterable[pa.RecordBatch], books: list[np.ndarray], dim: int, scale: int) -> Iterator[pa.RecordBatch]:
    """What the entries get from one task: (part, entry, component, digit, value) rows; component -1 has the count."""
    find = [Nearest(b) for b in books]
    total = [np.zeros(b.shape, object) for b in books]
    count = [np.zeros(len(b), np.int64) for b in books]
    for batch in batches:
        if not batch.num_rows:
            continue
        for p, x in enumerate(_slices(batch, "x", dim, len(books), scale)):
            place, _ = find[p](x)
            order = np.argsort(place, kind="stable")
            found, first = np.unique(place[order], return_index=True)
            if x.shape[1]:
                fits = x.dtype != object and _fits(x) and len(x) < 1 << 31
                added = np.add.reduceat(x[order] if fits else x[order].astype(object), first, axis=0)
                total[p][found] += added.astype(object)
            count[p] += np.bincount(place, minlength=len(books[p]))
    rows = []
    for p, (t, n) in enumerate(zip(total, count, strict=True)):
        for k in np.flatnonzero(n).tolist():
            rows.append((p, k, -1, 0, int(n[k])))
            rows += [(p, k, j, i, d) for j, v in enumerate(t[k].tolist()) for i, d in enumerate(digits(int(v)))]
    if rows:
        names = ("part", "entry", "component", "digit", "value")
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "value" else pa.int32()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=list(names))


def next_codebooks(vectors: DataFrame, books: list[np.ndarray], dim: int, scale: int) -> list[np.ndarray]:
    """The codebooks after one round over ``vectors`` (x); entries that get nothing stay."""
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(books)
    got = vectors.select("x").mapInArrow(lambda b: _sums(b, sent.value, dim, scale), "part int, entry int, component int, digit int, value long")
    rows = got.groupBy("part", "entry", "component", "digit").agg(F.sum("value").alias("value")).collect()  # bounded by the codebooks
    sent.unpersist()
    count = {(r.part, r.entry): r.value for r in rows if r.component < 0}
    sums = {(r.part, r.entry): [0] * b.shape[1] for r in rows if r.component < 0 for b in [books[r.part]]}
    for r in rows:
        if r.component >= 0:
            sums[r.part, r.entry][r.component] += r.value << (DIGIT * r.digit)
    out = []
    for p, b in enumerate(books):
        new = [[s // count[p, k] for s in sums[p, k]] if (p, k) in count else old for k, old in enumerate(b.tolist())]
        out.append(_integers(new, b.shape))
    return out


def _integers(rows: list[list[int]], shape: tuple[int, ...]) -> np.ndarray:
    wide = any(abs(v) >= 1 << 62 for r in rows for v in r)
    return np.array(rows, object if wide else np.int64).reshape(shape)


def _codes(batches: Iterable[pa.RecordBatch], books: list[np.ndarray], dim: int, scale: int) -> Iterator[pa.RecordBatch]:
    find = [Nearest(b) for b in books]
    for batch in batches:
        if not batch.num_rows:
            continue
        place, error = zip(*(f(x) for f, x in zip(find, _slices(batch, "x", dim, len(books), scale), strict=True)), strict=True)
        wide = any(e.dtype == object or e.size and e.max() > LONG // len(books) for e in error)
        total = sum(e.astype(object) for e in error) if wide else sum(error)
        told = pa.array([int(v) if v <= LONG else None for v in total], pa.int64()) if wide else pa.array(total, pa.int64())
        code = ["".join(f"{v:02x}" for v in row) for row in np.stack(place, axis=1).tolist()]
        keep = [batch.column(c) for c in batch.schema.names if c != "x"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(code, pa.string()), told], names=[*(c for c in batch.schema.names if c != "x"), "code", "error"])


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for row in b.tolist() for v in row).encode()).hexdigest()


def fit_codebooks(vectors: DataFrame, dim: int, parts: int, entries: int, rounds: int, scale: int) -> list[np.ndarray]:
    """Codebooks (one array of ``entries`` rows for each part) from all ``vectors`` (id, x), all of length ``dim``."""
    first = vectors.where("id is not null").orderBy("id", "x").limit(entries).select("x").collect()
    x = scaled(np.array([v for r in first for v in r.x], np.float64), scale).reshape(len(first), dim)
    step = dim // parts
    books = [np.ascontiguousarray(x[:, p * step : (p + 1) * step]) for p in range(parts)]
    for _ in range(rounds):
        books = next_codebooks(vectors, books, dim, scale)
    return books


def vector_codes(
    vectors: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256): see the module. ``scale`` is a power of two.

    ``code`` has two hex digits for each part in order; ``error`` is the sum of the squared distances over the parts,
    ``label_error`` its sum over the vectors with the same label (null labels are one).
    """
    if entries > 256 or scale & (scale - 1):
        raise ValueError("a code has one byte for each part, and the scale is a power of two")
    x = F.col(vector_col).cast("array<double>")
    broken = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.alias("x")).where(x.isNotNull() & ~broken)
    first = rows.where("id is not null").orderBy("id", "x").select(F.size("x").alias("n")).limit(1).collect()
    dim = first[0].n if first else -1
    if dim < 0 or dim % parts:
        return _told(rows.selectExpr("id", "label", "cast(null as string) code", "cast(null as long) error"), None, id_col, label_col)
    fine = rows.where(F.size("x") == dim)
    books = fit_codebooks(fine, dim, parts, entries, rounds, scale)
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = fine.mapInArrow(lambda b: _codes(b, sent.value, dim, scale), f"id {kinds['id']}, label {kinds['label']}, code string, error long")
    odd = rows.where(F.size("x") != dim).selectExpr("id", "label", "cast(null as string) code", "cast(null as long) error")
    return _told(coded.unionAll(odd), digest(books), id_col, label_col)


def _told(coded: DataFrame, sha: str | None, id_col: str, label_col: str) -> DataFrame:
    """With the sums over labels; a label with most of the rows is met by broadcast of its one sum."""
    keyed = cut(coded.withColumns({"no_label": F.col("label").isNull(), "key": F.coalesce(F.col("label").cast("string"), F.lit(""))}))
    sums = keyed.groupBy("no_label", "key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    whole = join_by_key(keyed, sums, ["no_label", "key"], "n", hot_bar(keyed.count()))
    return whole.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", F.lit(sha).cast("string").alias("codebooks_sha256"))
