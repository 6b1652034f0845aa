"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Features are the 1- and 2-grams of a text's words (A-Z lower-cased) and the 1- to 3-grams of the words' shapes (case,
digits and punctuation, runs shortened), each hashed to one of 2^18 numbers; a feature's value is its share of the
text's features. Labelled rows are dealt by hash over a fixed number of shards; each shard runs FTRL-proximal updates,
row by row in hash order, for some epochs; the shards' weights are averaged. A score is the sparse dot product of a
whole text's features with the weights, through the logistic function.

Bound: at most ``SAMPLE`` labelled rows train, half of them of either class as far as there are so many, those with the
smallest hashes. Everything else covers all rows. Reruns agree.

Nulls: a null or empty text has no features and gets the prior's score. Labels that are null or not 0 or 1 are not
learnt from; labels without a document neither. A doc_id with both labels is learnt once with each; of several rows of
a doc_id the smallest text is learnt. A null doc_id is scored, not learnt. Without labels of both classes every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ironsieve.llm.textvec import code_points, letter_table, lower_table, mix, portions, runs, slabs, space_table, span_hashes

BITS, SAMPLE, SHARDS, EPOCHS = 18, 12_288, 4, 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-6, 1e-6
SCALE = 20.0


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all rows joined, and the rows' offsets. Every occurrence is there."""
    letter, lower, space = letter_table(), lower_table(), space_table()
    rows, words, shapes = [], [], []
    for part, text in slabs(texts):
        cp = code_points(text)
        s, e = runs(~space[cp])
        if not len(s):
            continue
        rows.append(part[np.searchsorted(part[:, 1], s, side="right") - 1, 0])
        ascii_low = np.where((cp >= 65) & (cp <= 90), cp + np.uint32(32), cp)
        words.append(span_hashes(ascii_low, s, e))
        # shape: upper letter, other letter, digit, or the sign itself; of a run of one kind only the first counts
        kind = np.where(letter[cp], np.where(lower[cp] != cp, 1, 2), np.where((cp >= 48) & (cp <= 57), 3, cp + 4))
        new = np.concatenate([[True], kind[1:] != kind[:-1]])
        at = np.concatenate([[0], np.cumsum(new)])
        shapes.append(span_hashes(kind[new].astype(np.uint32), at[s], at[e]))
    n = len(texts)
    if not rows:
        return np.empty(0, np.int64), np.zeros(n + 1, np.int64)
    row, w, z = np.concatenate(rows), np.concatenate(words), np.concatenate(shapes)
    out, own = [], []
    shift = np.uint64(64 - BITS)
    for values, orders, salt in ((w, 2, 11), (z, 3, 23)):
        gram = np.zeros(len(values), np.uint64)
        for k in range(orders):
            gram = gram[: len(values) - k] if k else gram
            gram = mix(gram * np.uint64(31) + values[k:] + np.uint64(salt + k))
            keep = row[: len(gram)] == row[k:] if len(gram) else np.empty(0, bool)
            out.append((gram[keep] >> shift).astype(np.int64))
            own.append(row[: len(gram)][keep])
    out, own = np.concatenate(out), np.concatenate(own)
    order = np.argsort(own, kind="stable")
    return out[order], np.searchsorted(own[order], np.arange(n + 1))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        f, at = features(texts)
        n = np.diff(at)
        total = np.zeros(len(n))  # each text's own sum, whatever stands beside it
        if len(f):
            total[n > 0] = np.add.reduceat(self.weights[f], at[:-1][n > 0])
        raw = self.bias + SCALE * total / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (numbers, values, label) rows in the given order; number 2^BITS is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weight(i):
        w = (np.sign(z[i]) * L1 - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) <= L1, 0.0, w)

    for _ in range(epochs):
        for i, x, y in rows:
            w = weight(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -40, 40)))
            g = (p - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weight(np.arange(len(z)))
    return w[:-1], float(w[-1])


def _train(epochs: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("id", "ascending"), ("y", "ascending")])
        labels, rows = table["y"].to_pylist(), []
        for at, texts in portions(table["text"].combine_chunks()):
            f, to = features(texts)
            for r in range(len(texts)):
                i, c = np.unique(f[to[r] : to[r + 1]], return_counts=True)
                x = SCALE * c / max(1, to[r + 1] - to[r])
                rows.append((np.append(i, 1 << BITS).astype(np.int32), np.append(x, 1.0).astype(np.float32), labels[at + r]))
        w, bias = ftrl(rows, epochs)
        return pa.table({"w": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "bias": [bias], "n": [len(rows)]})

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> Model:
    """A model from ``docs`` (id, text) and ``labels`` (id, y)."""
    key = F.xxhash64(F.col("id"), F.lit("quality"))
    known = labels.where("id is not null and y in (0, 1)").select("id", F.col("y").cast("int").alias("y"), key.alias("key")).distinct()
    # of each class the rows with the smallest keys: the cut of a uniform key that leaves half the sample
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        share = 1.0 if counts.get(1) else 0.0 if counts else 0.5
        return Model(np.zeros(1 << BITS), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    part = F.lit(None)
    for y, n in counts.items():
        part = F.when(F.col("y") == y, F.lit(min(1.0, sample / 2 / n))).otherwise(part)
    chosen = known.where((F.shiftrightunsigned("key", 33) / F.lit(float(1 << 31))) < part)
    rows = docs.join(F.broadcast(chosen), "id").groupBy("id", "y", "key").agg(F.min("text").alias("text"))
    rows = rows.withColumn("shard", F.pmod("key", F.lit(SHARDS)).cast("int"))
    parts = rows.groupBy("shard").applyInArrow(_train(epochs), "w binary, bias double, n long").collect()
    if not parts:
        return Model(np.zeros(1 << BITS), 0.0)
    share = np.array([r.n for r in parts], float) / sum(r.n for r in parts)
    w = sum(s * np.frombuffer(r.w, np.float32).astype(float) for s, r in zip(share, parts, strict=True))
    return Model(w, float(sum(s * r.bias for s, r in zip(share, parts, strict=True))))


def held_out(id_col: str, folds: int, fold: int):
    """Whether the remainder of the id's CRC-32 (as text) is the fold kept from training; null ids are kept, too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(True))


def quality_scores(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, fold: int = 1
) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.concatenate([held.value.scores(t) for _, t in portions(b.column(2))] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))],
                [id_col, "held_out", "score", "predicted"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, held_out(id_col, folds, fold).alias("held_out"), text_col).mapInArrow(
        run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int"
    )


def train_on_folds(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, **options) -> Model:
    """A model from the labelled rows (doc_id, quality) whose fold isn't kept."""
    known = labels.where(~held_out("doc_id", folds, fold)).select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    return train(docs.select(F.col("doc_id").alias("id"), "text"), known, **options)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose score is at least ``least``, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [held.value.scores(t) for _, t in portions(b.column(place))]
            yield b.filter(pa.array(np.concatenate([*s, np.empty(0)]) >= least))

    return docs.mapInArrow(run, docs.schema)
