"""Language identification, words first.

Known words score by their per-language log frequency. A word that was not learnt falls back to its character n-grams:
of the longest order of which any is known, the mean log frequency of the known ones; else the next shorter order, down
to single letters; a word with none of these tells nothing. A text's language is the one with the largest sum over all
words of the whole text; its score is the posterior share, tempered by the square root of the number of words.

Words are runs of letters (Unicode category L), lower-cased; n-grams run over a word with its two ends marked.

Any number of languages: entries keep numbers only for the languages that they were seen in, the rest is one number for
each language. Bound: of each language about ``SAMPLE`` learnt texts (those with the smallest hashes of their ids) are
counted, and about ``TEXTS`` of all languages together, so with many languages fewer of each; words seen once in them are
left to the n-grams, as unseen words will look like them. Everything else covers all rows. Reruns agree.

Nulls: rows with a null language, text or id are not learnt from. A text that is null or has no letter is ``und`` with
score 0, as is every text if nothing was learnt. Of several rows of an id in one language the smallest text is learnt. Ties go to the language
that comes first by code point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ironsieve.llm.quality import held_out
from ironsieve.llm.textvec import HashIndex, code_points, letter_table, lower_table, mix, portions, runs, slabs, span_hashes
from ironsieve.operators.components import HOT_ROWS, join_by_key
from ironsieve.session import cut

SAMPLE, TEXTS, ORDERS, SMOOTH = 3000, 120_000, (4, 3, 2, 1), 0.5
_END = np.uint32(0x110000)


def words_of(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, hash, lower-cased code points, starts, ends) of the words, by slabs."""
    letter, lower = letter_table(), lower_table()
    for part, text in slabs(texts):
        cp = code_points(text)
        s, e = runs(letter[cp])
        if len(s):
            low = lower[cp]
            yield part[np.searchsorted(part[:, 1], s, side="right") - 1, 0], span_hashes(low, s, e), low, s, e


def grams(low: np.ndarray, s: np.ndarray, e: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, hash) of every n-gram of the given words, ends marked; single letters have no marks."""
    pad = int(order > 1)
    size = e - s + 2 * pad
    at = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(len(s)), size)
    place = np.arange(at[-1]) - at[word] + s[word] - pad
    text = low[np.clip(place, 0, len(low) - 1)].astype(np.uint32)
    text[(place < s[word]) | (place >= e[word])] = _END
    if len(text) < order:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.full(len(text) - order + 1, order, np.uint64)
    for j in range(order):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + text[j : len(text) - order + 1 + j].astype(np.uint64))
    inside = word[: len(h)] == word[order - 1 :]
    return word[: len(h)][inside], h[inside]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (order 0) and n-grams, combined for each slab of text."""
    for b in batches:
        langs = np.array(b.column(0).to_pylist(), object)
        for at, texts in portions(b.column(1)):
            found: dict[tuple[int, str], list[tuple[np.ndarray, np.ndarray]]] = {}
            for row, h, low, s, e in words_of(texts):
                lang = langs[at + row]
                for one in sorted(set(lang)):
                    own = lang == one
                    found.setdefault((0, one), []).append(np.unique(h[own], return_counts=True))
                    for order in ORDERS:
                        g = grams(low, s[own], e[own], order)[1]
                        found.setdefault((order, one), []).append(np.unique(g, return_counts=True))
            for (order, one), parts in found.items():
                h, c = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_pydict(
                    {
                        "ord": pa.array(np.full(len(h), order, np.int32)),
                        "h": pa.array(h.view(np.int64)),
                        "lang": pa.array([one] * len(h), pa.string()),
                        "c": pa.array(c.astype(np.int64)),
                    }
                )


@dataclass
class Table:
    """Log frequencies of words or n-grams of one order: of each language where an entry wasn't seen in it, and by entry
    what is added for the languages where it was."""

    index: HashIndex
    rest: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    more: np.ndarray

    def of(self, got: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``got``, language, what is added) of these entries."""
        size = self.start[got + 1] - self.start[got]
        end = np.cumsum(size)
        at = np.repeat(self.start[got] - (end - size), size) + np.arange(end[-1] if len(end) else 0)
        return np.repeat(np.arange(len(got)), size), self.lang[at], self.more[at]


@dataclass
class Model:
    langs: list[str]
    #: by order (0: words)
    tables: dict[int, Table]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n, k = len(texts), len(self.langs)
        total, count = np.zeros(n * max(k, 1)), np.zeros(n)
        for row, h, low, s, e in words_of(texts):
            count += np.bincount(row, minlength=n)
            if not k:
                continue

            def add(rows: np.ndarray, lang: np.ndarray, more: np.ndarray) -> None:
                nonlocal total
                total += np.bincount(rows * k + lang, more, n * k)

            def add_rest(rows: np.ndarray, table: Table) -> None:
                nonlocal total
                total += np.outer(np.bincount(rows, minlength=n), table.rest).ravel()

            table = self.tables[0]
            got = table.index.find(h)
            known = got >= 0
            at, lang, more = table.of(got[known])
            add(row[known][at], lang, more)
            add_rest(row[known], table)
            left = np.flatnonzero(~known)
            # unseen words repeat, too: each is scored once
            uniq, first, back = np.unique(h[left], return_index=True, return_inverse=True)
            order_of = np.zeros(len(uniq), np.int64)
            size, parts = np.zeros(len(uniq), np.int64), []
            todo = np.arange(len(uniq))
            for order in ORDERS:
                if not len(todo):
                    break
                at = left[first[todo]]
                word, g = grams(low, s[at], e[at], order)
                table = self.tables[order]
                got = table.index.find(g)
                word, got = word[got >= 0], got[got >= 0]
                hits = np.bincount(word, minlength=len(todo))
                at, lang, more = table.of(got)
                # one number for each word and language
                pair, which = np.unique(word[at] * k + lang, return_inverse=True)
                parts.append((todo[pair // k], pair % k, np.bincount(which, more, len(pair)) / hits[pair // k]))
                order_of[todo[hits > 0]] = order
                todo = todo[hits == 0]
            if parts:
                word, lang, more = (np.concatenate(x) for x in zip(*parts, strict=True))
                by = np.argsort(word, kind="stable")
                word, lang, more = word[by], lang[by], more[by]
                size = np.bincount(word, minlength=len(uniq))
                start = np.concatenate([[0], np.cumsum(size)])
                mine = size[back]
                end = np.cumsum(mine)
                at = np.repeat(start[back] - (end - mine), mine) + np.arange(end[-1] if len(end) else 0)
                add(np.repeat(row[left], mine), lang[at], more[at])
            for order in ORDERS:
                add_rest(row[left][order_of[back] == order], self.tables[order])
        total = total.reshape(n, max(k, 1))
        if not k:
            return ["und"] * n, np.zeros(n)
        best = total.argmax(axis=1)
        soft = np.exp((total - total.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(count, 1))[:, None])
        score = soft[np.arange(n), best] / soft.sum(axis=1)
        none = count == 0
        return ["und" if x else self.langs[b] for x, b in zip(none, best, strict=True)], np.where(none, 0.0, score)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from (id, text, lang) rows."""
    rows = docs.where("id is not null and text is not null and lang is not null")
    sizes = cut(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))
    sample = min(float(sample), TEXTS / max(1, sizes.count()))
    key = F.shiftrightunsigned(F.xxhash64("id", F.lit("language")), 33) / F.lit(float(1 << 31))
    chosen = join_by_key(rows, sizes.select("lang", "rows", F.col("rows").alias("n")), ["lang"], "n", HOT_ROWS).where(key < F.lit(float(sample)) / F.col("rows"))
    chosen = chosen.groupBy("id", "lang").agg(F.min("text").alias("text")).select("lang", "text")
    counts = chosen.mapInArrow(_count, "ord int, h long, lang string, c long")
    counts = cut(counts.groupBy("ord", "h", "lang").agg(F.sum("c").alias("c")))
    total = F.sum("c").alias("total")
    # an entry for each word or n-gram that was seen twice; bounded by the sample's words
    entries = (
        counts.groupBy("ord", "h")
        .agg(total, F.collect_list(F.struct("lang", "c")).alias("by"))
        .where("total > 1")
        .select("ord", "h", "by")
    )
    sums = {(r.ord, r.lang): (r.n, r.v) for r in counts.groupBy("ord", "lang").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    langs = sorted({lang for _, lang in sums})
    place = {x: i for i, x in enumerate(langs)}
    got = entries.select("ord", "h", "by.lang", "by.c").toArrow()
    order, h = got["ord"].to_numpy(), got["h"].to_numpy().view(np.uint64)
    lists = got["lang"].combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    lang = np.array([place[x] for x in lists.flatten().to_pylist()], np.int64)
    c = got["c"].combine_chunks().flatten().to_numpy().astype(np.float64)
    entry = np.repeat(np.arange(len(h)), size)
    tables = {}
    for o in (0, *ORDERS):
        pick = np.flatnonzero(order == o)
        at = np.full(len(h), -1)
        at[pick] = np.arange(len(pick))
        own = np.flatnonzero(at[entry] >= 0)
        own = own[np.argsort(at[entry[own]], kind="stable")]
        start = np.concatenate([[0], np.cumsum(np.bincount(at[entry[own]], minlength=len(pick)))])
        norm = np.array([(lambda n, v: n + SMOOTH * (v + 1))(*sums.get((o, x), (0, 0))) for x in langs])
        tables[o] = Table(HashIndex(h[pick]), np.log(SMOOTH / norm), start, lang[own], np.log1p(c[own] / SMOOTH))
    return Model(langs, tables)


def predict_languages(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, fold: int = 2
) -> DataFrame:
    """(id, held_out, lang_pred, score) for every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = [], [np.empty(0)]
            for _, texts in portions(b.column(2)):
                x, y = held.value.predict(texts)
                lang += x
                score.append(y)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(np.concatenate(score))],
                [id_col, "held_out", "lang_pred", "score"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, held_out(id_col, folds, fold).alias("held_out"), text_col).mapInArrow(
        run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double"
    )


def train_on_folds(docs: DataFrame, folds: int = 4, fold: int = 2, **options) -> Model:
    """A model from the documents (doc_id, text, lang) whose fold isn't kept."""
    known = docs.where(~held_out("doc_id", folds, fold))
    return train(known.select(F.col("doc_id").alias("id"), "text", "lang"), **options)
