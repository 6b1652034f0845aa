"""Benchmark decontamination by template canonicalisation.

Tokens are runs of letters and runs of digits (with inner ``.`` and ``,``); in scripts without spaces between words,
every letter is a token. In the template of a text, numbers (digits
and number words), names (capitalised words inside a sentence, common first names anywhere) and units (after a number)
become typed placeholders. The windows of every benchmark item, as plain lower-cased tokens and as templates, form a
hash table that every task gets; each document's windows are joined with it. For windows that match as templates, the
slots must agree: along one alignment, an item's value may stand for one value of the document only. What fails that is
a common phrase pattern, not a re-parameterised question, and is dropped.

A template window with fewer than ``_LITERAL`` tokens that are no placeholders is lengthened until it holds so many; if
the item ends first, it has no template. An item without any template window matches by the template of all its tokens,
if one of them is no placeholder.

A document leaks an item if the matched windows are at least ``cover`` of the item's windows or ``least`` of them, or if
so many of the windows that have a template match with their whole template. ``matched_windows`` and ``item_windows``
are those of the larger share. The benchmark is taken in shards of bounded size, so the table that tasks hold is bounded.
With more than one shard, one pass over the documents first tells, by a bit array of all windows' hashes (bounded, too),
which documents can match at all; only those go on to the shards. So every document is read once for a benchmark of any size.

Nulls: null or empty texts and items match nothing. Items of fewer tokens than ``window`` match by one window of all
their tokens, those of fewer than ``SHORTEST`` only as plain tokens: an item of one common word is in many texts. Rows that repeat a doc_id or an item_id are reported once
with their best match. Ids are integers, or texts of such (others are an error). Empty tables give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ironsieve.llm.textvec import HashIndex, code_points, letter_table, lower_table, mix, portions, slabs, span_hashes
from ironsieve.session import cut

WINDOW, SHORTEST, COVER, LEAST = 8, 5, 0.3, 12
#: Characters of benchmark text in a shard, about.
SHARD = 8_000_000
_LITERAL = 5  # of a template window's tokens, so many at least are no placeholders
#: Scripts without spaces between words: Thai, Lao, Myanmar, Khmer, kana, ideographs.
_UNSPACED = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))

#: Number words and units of English, German, French and Spanish; articles that also mean one are none.
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend million millionen dutzend "
    "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille millions douzaine "
    "dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil millón millones docena"
).split()
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonnes ounce ounces pound pounds lb lbs ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours h day days week weeks month months year years percent dollar dollars usd euro euros eur cent cents degree degrees celsius fahrenheit kelvin watt watts kw kwh volt volts amp amps joule joules newton newtons hz khz mhz ghz byte bytes kb mb gb tb mph kmh "
    "meter metern kilometer kilometern meilen gramm kilogramm tonnen pfund litern gallonen sekunden minuten stunden tage tagen wochen monate jahre jahren prozent grad "
    "mètre mètres kilomètre kilomètres grammes kilogrammes litres secondes heure heures jour jours semaine semaines mois ans années degrés "
    "metro metros kilómetro kilómetros millas gramos kilos kilogramos toneladas litros galones segundos minutos hora horas día días semanas meses años grados"
).split()
FIRST_NAMES = "james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen anna emma olivia sophia lucas noah liam ethan daniel matthew mark paul peter george henry jack tom tim sam ben alice bob carol dave eve frank grace helen jane janet julia kate laura lisa maria natalia nancy rachel ruth tina betty alexis carlos juan pedro sofia pierre marie jean hans klaus greta".split()


def _word_hashes(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        cp = code_points(w)
        out.append(span_hashes(cp, np.array([0]), np.array([len(cp)]))[0])
    return np.array(out, np.uint64)


_NUM, _NAME, _UNIT = 1, 2, 3
_SLOT = mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x7F4A7C15F39CC060))
_FOLD = [np.uint64(pow(0xD1342543DE82EF95, i + 1, 1 << 64)) for i in range(64)]
_UNFOLD = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


@dataclass
class Tokens:
    """The tokens of many rows: per token its row, hash, kind (0 or a slot) and text span; ``at``: the rows' offsets."""

    row: np.ndarray
    hash: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray

    def template(self) -> np.ndarray:
        return np.where(self.kind > 0, _SLOT[self.kind], self.hash)


def tokens(texts: list[str | None]) -> Tokens:
    number_words, units, names = (_word_hashes(x) for x in (NUMBER_WORDS, UNITS, FIRST_NAMES))
    letter, lower = letter_table(), lower_table()
    rows, hashes, kinds, starts, ends = [], [], [], [], []
    for part, text in slabs(texts):
        cp = code_points(text)
        digit = (cp >= 48) & (cp <= 57)
        joint = (cp == 46) | (cp == 44)
        joint[1:-1] &= digit[:-2] & digit[2:]
        c = letter[cp].view(np.int8) + 2 * (digit | joint[: len(cp)] & np.concatenate([[False], digit[:-1]])).view(np.int8)
        alone = np.zeros(len(cp), bool)
        for low, high in _UNSPACED:
            alone |= (cp >= low) & (cp <= high)
        change = (c[1:] != c[:-1]) | alone[1:] | alone[:-1]
        s = np.flatnonzero(change & (c[1:] > 0)) + 1
        e = np.flatnonzero(change & (c[:-1] > 0)) + 1
        if not len(s):
            continue
        low = lower[cp]
        h = span_hashes(low, s, e)
        where = np.searchsorted(part[:, 1], s, side="right") - 1
        row = part[where, 0]
        stops = np.cumsum(np.isin(cp, np.frombuffer(".!?:;|\n".encode("utf-32-le"), np.uint32)))
        begins = np.ones(len(s), bool)
        begins[1:] = (stops[s[1:]] - stops[e[:-1]-1] > 0) | (row[1:] != row[:-1])
        capital = low[s] != cp[s]
        second = np.where(e - s > 1, s + 1, s)
        proper = capital & (low[second] == cp[second]) & (e - s > 1)
        kind = np.zeros(len(s), np.int8)
        kind[(c[s] >= 2) | np.isin(h, number_words)] = _NUM
        after = np.zeros(len(s), bool)
        after[1:] = (kind[:-1] == _NUM) & (row[1:] == row[:-1])
        kind[after & (kind == 0) & np.isin(h, units)] = _UNIT
        kind[(kind == 0) & proper & (~begins | np.isin(h, names))] = _NAME
        rows.append(row)
        hashes.append(h)
        kinds.append(kind)
        shift = part[where, 2] - part[where, 1]
        starts.append(s + shift)
        ends.append(e + shift)
    if not rows:
        none = np.empty(0, np.int64)
        return Tokens(none, none.astype(np.uint64), none.astype(np.int8), none, none, np.zeros(len(texts) + 1, np.int64))
    row = np.concatenate(rows)
    return Tokens(
        row,
        np.concatenate(hashes),
        np.concatenate(kinds),
        np.concatenate(starts),
        np.concatenate(ends),
        np.searchsorted(row, np.arange(len(texts) + 1)),
    )


def windows(values: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First tokens and hashes of the n-token windows that stay inside a row."""
    if len(values) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.zeros(len(values) - n + 1, np.uint64)
    for j in range(n):
        h += values[j : len(values) - n + 1 + j] * _FOLD[j]
    at = np.flatnonzero(row[: len(h)] == row[n - 1 :])
    return at, mix(h[at])


def spans(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of token spans of any lengths."""
    n = len(values)
    up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)])) for x in (_FOLD[0], _UNFOLD))
    total = np.concatenate([[np.uint64(0)], np.cumsum(values * up[:n])])
    return mix(((total[end] - total[start]) * down[start]) ^ (end - start).astype(np.uint64))


def grown(tok: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First tokens and ends of the dense n-token windows, lengthened to ``_LITERAL`` literals inside their row."""
    literal = np.flatnonzero(tok.kind == 0)
    if len(literal) < _LITERAL:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.arange(len(tok.kind))
    last = np.searchsorted(literal, at) + _LITERAL - 1
    at = at[last < len(literal)]
    end = literal[last[: len(at)]] + 1
    keep = (end > at + n) & (tok.row[end - 1] == tok.row[at])
    return at[keep], end[keep]


class Benchmark:
    """The windows of a shard of items in a hash table."""

    def __init__(self, items: list[tuple[int, str | None]], window: int, cover: float, least: int):
        self.ids = [i for i, _ in items]
        self.cover, self.least = cover, least
        texts = [t for _, t in items]
        tok = tokens(texts)
        size = np.diff(tok.at)
        self.window = window
        self.windows = np.maximum(size - window + 1, 1)
        self.slots = []
        for i, t in enumerate(texts):
            a, b = tok.at[i], tok.at[i + 1]
            self.slots.append([t[tok.start[x] : tok.end[x]].lower() if tok.kind[x] else "" for x in range(a, b)])
        template = tok.template()
        #: By item: starts of windows that are their own template or have one of the same length; all that have one.
        self.regular: list[set[int]] = [set() for _ in texts]
        self.admitted = np.zeros(len(texts), np.int64)
        self.sizes: dict[int, tuple] = {int(n): () for n in np.unique(np.minimum(size, window)) if n}
        for n in self.sizes:
            found = []
            for form, values in enumerate((tok.hash, template)):
                if form and n < SHORTEST:
                    continue
                at, h = windows(values, tok.row, n)
                item = tok.row[at]
                keep = (size[item] >= window) if n == window else (size[item] == n)
                if form:
                    keep &= fits(tok.kind, at, n, window)
                own = keep if form or n < window else keep & ~dense(tok.kind, at, n)
                for i, p in zip(item[own].tolist(), (at - tok.at[item])[own].tolist(), strict=True):
                    self.regular[i].add(p)
                found.append((h[keep], item[keep], (at - tok.at[item])[keep]))
            self.sizes[n] = table(*(np.concatenate(x) for x in zip(*found, strict=True)))
        self.admitted += [len(x) for x in self.regular]
        at, end = grown(tok, window)
        item = tok.row[at]
        np.add.at(self.admitted, item, 1)
        self.grown = table(spans(template, at, end), item, at - tok.at[item])
        literals = np.bincount(tok.row[tok.kind == 0], minlength=len(texts))
        bare = np.flatnonzero((size >= window) & (self.admitted == 0) & (literals > 0))
        self.admitted[bare] = 1
        self.bare = {}
        for n in np.unique(size[bare]):
            item = bare[size[bare] == n]
            h = spans(template, tok.at[item], tok.at[item + 1])
            self.bare[int(n)] = table(h, item, np.full(len(item), -1))

    def hashes(self) -> np.ndarray:
        """Of all windows."""
        found = [*self.sizes.values(), self.grown, *self.bare.values()]
        return np.concatenate([np.empty(0, np.uint64), *(x[0].keys[x[0].rows >= 0] for x in found)])

    def shape(self) -> Shape:
        return Shape(self.window, tuple(self.sizes), bool(len(self.grown[2])), tuple(self.bare))

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int, bool]]:
        """(row, item number, matched windows, windows counted, whether some slot differs) of every leak."""
        tok = tokens(texts)
        out, hits = [], []
        for form, n, at, end, h in self.shape().windows(tok):
            index, edge, item, pos = self.sizes[n] if form in ("plain", "template") else self.grown if form == "grown" else self.bare[n]
            got = index.find(h)
            k = np.flatnonzero(got >= 0)
            many = edge[got[k] + 1] - edge[got[k]]
            x = np.repeat(edge[got[k]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            row, k = tok.row[np.repeat(at[k], many)], np.repeat(k, many)
            if form == "plain" and n < SHORTEST:
                out += [(int(r), int(i), 1, 1, False) for r, i in set(zip(row.tolist(), item[x].tolist(), strict=True))]
                continue
            hits.append(np.stack([row, item[x], at[k] - np.maximum(pos[x], 0), pos[x], at[k], end[k], np.full(len(k), form != "plain")]))
        if not hits:
            return out
        hits = np.concatenate(hits, axis=1)
        hits = hits[:, np.lexsort((hits[3], hits[1], hits[0]))]
        new = np.ones(hits.shape[1], bool)
        new[1:] = (hits[:2, 1:] != hits[:2, :-1]).any(axis=0)
        # pairs of a text and an item with fewer hits than a leak needs go at once
        start = np.flatnonzero(new)
        places = new.copy()
        places[1:] |= hits[3, 1:] != hits[3, :-1]
        if len(start):
            most = np.add.reduceat(places.astype(np.int64), start)
            own = hits[1, start]
            need = np.stack([self._need(self.windows[own]), self._need(self.admitted[own])])
            fine = (most >= need.min(axis=0)).tolist()
            for s, e, go in zip(start, [*start[1:], hits.shape[1]], fine, strict=True):
                if go:
                    out += self._leak(tok, texts, hits[:, s:e])
        return out

    def _need(self, n: np.ndarray) -> np.ndarray:
        """So many matched windows of n make a leak."""
        return np.where(n > 0, np.minimum(self.least, np.maximum(1, self.cover * n)), np.inf)

    def _leak(self, tok: Tokens, texts: list[str | None], hits: np.ndarray) -> list[tuple[int, int, int, int, bool]]:
        """The leak of one item in one text, if it is one."""
        row, item = int(hits[0, 0]), int(hits[1, 0])
        # alignment -> starts of plain windows, start of a template window (-1: the item) -> its place
        by = defaultdict(lambda: (set(), {}))
        for shift, p, a, b, loose in hits[2:].T.tolist():
            if loose:
                by[shift][1][p] = (a, b)
            else:
                by[shift][0].add(p)
        matched, typed, differs = set(), set(), False
        for plain, loose in by.values():
            sure = {p for p in plain if p in self.regular[item]}
            loose = {p: w for p, w in loose.items() if p not in sure}
            if loose:
                means: dict[str, set[str]] = defaultdict(set)
                for p, (a, b) in loose.items():
                    for q in range(b - a):
                        if tok.kind[a + q]:
                            own = texts[row][tok.start[a + q] : tok.end[a + q]].lower()
                            means[self.slots[item][max(p, 0) + q]].add(own)
                if all(len(v) == 1 for v in means.values()):
                    sure |= set(loose)
                    differs |= any(k not in v for k, v in means.items())
            typed |= sure
            matched |= plain | {p for p in sure if p >= 0}
        counts = [(len(matched), int(self.windows[item])), (len(typed), int(self.admitted[item]))]
        leaks = [(m / n, m, n) for m, n in counts if n and m >= min(self.least, max(1, self.cover * n))]
        return [(row, item, *max(leaks)[1:], differs)] if leaks else []


@dataclass
class Shape:
    """Which windows of a text can match: lengths of plain windows, whether there are lengthened ones, and of which
    lengths whole items are matched by their template."""

    window: int
    sizes: tuple[int, ...]
    grown: bool
    bare: tuple[int, ...]

    def __or__(self, other: Shape) -> Shape:
        return Shape(self.window, tuple(sorted({*self.sizes, *other.sizes})), self.grown or other.grown, tuple(sorted({*self.bare, *other.bare})))

    def windows(self, tok: Tokens) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(form, length, first tokens, ends, hashes)."""
        template = tok.template()
        for n in self.sizes:
            at, h = windows(tok.hash, tok.row, n)
            yield "plain", n, at, at + n, h
            if n >= SHORTEST:
                at, h = windows(template, tok.row, n)
                some = fits(tok.kind, at, n, self.window)
                yield "template", n, at[some], at[some] + n, h[some]
        if self.grown:
            at, end = grown(tok, self.window)
            yield "grown", 0, at, end, spans(template, at, end)
        for n in self.bare:
            at = np.arange(max(0, len(tok.row) - n + 1))
            at = at[tok.row[at] == tok.row[at + n - 1]]
            yield "bare", n, at, at + n, spans(template, at, at + n)


class Screen:
    """A bit for the first bits of every window hash of the whole benchmark: texts without a set bit match nothing."""

    def __init__(self, windows: int):
        self.bits = min(30, max(10, int(16 * windows).bit_length()))
        self.set = np.zeros(1 << (self.bits - 3), np.uint8)
        self.shape: Shape | None = None

    def _place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        return at >> 3, np.uint8(1) << (at & 7).astype(np.uint8)

    def add(self, shard: Benchmark) -> None:
        np.bitwise_or.at(self.set, *self._place(shard.hashes()))
        self.shape = shard.shape() | self.shape if self.shape else shard.shape()

    def rows(self, texts: list[str | None]) -> np.ndarray:
        """Whether each text may match."""
        tok, out = tokens(texts), np.zeros(len(texts), bool)
        for _, _, at, _, h in self.shape.windows(tok):
            byte, bit = self._place(h)
            out[tok.row[at[(self.set[byte] & bit) > 0]]] = True
        return out


def table(h: np.ndarray, item: np.ndarray, pos: np.ndarray) -> tuple[HashIndex, np.ndarray, np.ndarray, np.ndarray]:
    """An index of the distinct hashes, the edges of their runs, and the runs' items and positions."""
    order = np.argsort(h, kind="stable")
    h, item, pos = h[order], item[order], pos[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return HashIndex(h[first]), np.append(first, len(h)), item, pos


def dense(kind: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Windows with slots."""
    slots = np.concatenate([[0], np.cumsum(kind > 0)])
    return slots[at + n] > slots[at]


def fits(kind: np.ndarray, at: np.ndarray, n: int, window: int) -> np.ndarray:
    """Windows with slots, but enough literal tokens besides: for whole items of fewer tokens than a window, one."""
    slots = np.concatenate([[0], np.cumsum(kind > 0)])
    inside = slots[at + n] - slots[at]
    return (inside > 0) & (n - inside >= (min(_LITERAL, n - 1) if n == window else 1))


class Shards:
    """The benchmark in shards, each built when it is its turn: (id, text) columns, and how windows are made and counted."""

    def __init__(self, bench: DataFrame, id_col: str, text_col: str, window: int, cover: float, least: int):
        self.bench, self.columns, self.how = bench.select(id_col, text_col), (id_col, text_col), (window, cover, least)
        self.chars = bench.agg(F.sum(F.length(text_col))).first()[0] or 0
        self.count = -(-self.chars // SHARD)

    def __iter__(self) -> Iterator[Benchmark]:
        for s in range(self.count):
            part = self.bench.where(F.pmod(F.xxhash64(*self.columns), F.lit(self.count)) == s)
            yield Benchmark([(r[0], r[1]) for r in part.orderBy(*self.columns).collect()], *self.how)

    def screen(self) -> Screen:
        out = Screen(self.chars // 3)  # about two windows, as they are and as templates, for each word
        for shard in self:
            out.add(shard)
        return out


_MAYBE = "__may_match"


def _screened(docs: DataFrame, text_col: str, screen: Screen) -> DataFrame:
    """``docs`` and whether a row may match."""
    held = docs.sparkSession.sparkContext.broadcast(screen)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = [held.value.rows(texts) for _, texts in portions(batch.column(place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.empty(0, bool), *may]))], [*batch.schema.names, _MAYBE])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(_MAYBE, T.BooleanType())]))


def leaked_items(
    docs: DataFrame,
    bench: DataFrame,
    window: int = WINDOW,
    cover: float = COVER,
    least: int = LEAST,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, matched_windows, item_windows, coverage, reparameterised): a row for each leak."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, matched_windows int, item_windows int, reparameterised boolean"
    names, types = zip(*((x.split()[0], {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[x.split()[1]]) for x in schema.split(", ")), strict=True)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    shards = Shards(bench, item_col, item_text_col, window, cover, least)
    if shards.count > 1:
        docs = cut(_screened(docs, "text", shards.screen()).where(_MAYBE).drop(_MAYBE))
    out = spark.createDataFrame([], schema)
    for shard in shards:
        held = spark.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            b = held.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for at, texts in portions(batch.column(1)):
                    found = [(ids[at + row], b.ids[item], n, of, differs) for row, item, n, of, differs in b.matches(texts)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], names)

        out = out.unionAll(docs.mapInArrow(run, schema))
    best = out.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("matched_windows", "item_windows", "reparameterised")).alias("m")
    )
    return best.select(
        "doc_id", "item_id", "m.*", (F.col("m.matched_windows") / F.col("m.item_windows")).alias("coverage")
    )


def drop_leaks(docs: DataFrame, bench: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns."""
    spark, columns, schema = docs.sparkSession, docs.columns, docs.schema
    shards = Shards(bench, "item_id", "text", *(options.get(k, v) for k, v in (("window", WINDOW), ("cover", COVER), ("least", LEAST))))
    place, screened = columns.index(text_col), shards.count > 1
    if screened:
        docs = _screened(docs, text_col, shards.screen())
        schema = docs.schema
    for shard in shards:
        held = spark.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                may = np.flatnonzero(batch.column(len(columns))) if screened else None
                own = batch.column(place) if may is None else batch.column(place).take(pa.array(may))
                for at, texts in portions(own):
                    rows = [at + row for row, *_ in held.value.matches(texts)]
                    keep[rows if may is None else may[rows]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs.drop(_MAYBE) if screened else docs
