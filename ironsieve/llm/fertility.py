"""Quality rules by tokeniser fertility.

Public vocabularies, read and never trained, take every word of a text apart: a SentencePiece model with byte fallback
and a byte-level BPE. Each gives three measures of a text: characters a token, the share of tokens that are single bytes
of a character (byte fallback) and the entropy of its tokens. Texts are compared with all texts of their language, or of
their script where no language is given, of about the same length: exact histograms of the measures over the whole table
give for each of these groups the median and quartiles, and from them a band. A text is rejected if one measure is
outside of its band by all vocabularies. Groups with fewer than ``least`` texts take the band of their language or
script at all lengths, then that of the whole table, which say nothing about entropy; with fewer texts than that nothing
is rejected.

One pass over the texts makes one small row for each; the texts are not shuffled. Distinct words of some texts together
are taken apart once. Words longer than SECTION characters are taken apart section by section; whole texts are measured.

Base rules come first (few words, repeated five-word windows), and bands are learnt from what passes them.

Nulls: a null or empty text has no words and fails the base rules; a null language is that of the script, a text without
letters has script "none". Ids may be null or repeated: each row is judged, and counts, by itself. An empty table gives
no rows.
"""

from __future__ import annotations

import base64
import functools
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ironsieve.llm.textvec import mix, portions
from ironsieve.operators.components import hot_bar, join_by_key
from ironsieve.session import cut

FOLDER = "/opt/tokenizers"
VOCABULARIES = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")
#: What parts the words, the symbols, and the pattern that byte-level vocabularies split words by.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW = 5
SECTION = 4096
KNOWN = 300_000
MEASURES = ("chars_per_token", "byte_share", "entropy")
#: Bins for each unit: of the logarithm (base 2) of characters a token, of the share, of the entropy in bits.
BINS = (32, 256, 16)
#: A band begins at least so many bins below the median and ends so many above; it reaches so many times as far as the
#: quartiles do.
LEAST_BELOW, LEAST_ABOVE = (16, 26, 16), (24, 26, 16)
REACH = 6
#: Entropy follows the length, so only texts of about the same length tell its band; other bands leave it open.
OPEN = 1 << 30
BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, length int, bins array<int>, measures array<double>"


class Pieces:
    """A SentencePiece model."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())], bool)

    def __call__(self, words: list[str]) -> list[list[int]]:
        return self.model.encode(words, num_threads=1)


class Ranks:
    """A byte-level BPE from a file of ranks; words are taken with a blank before them."""

    def __init__(self, data: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.model = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.byte = np.zeros(max(ranks.values()) + 1, bool)
        for token, i in ranks.items():
            try:
                token.decode()
            except UnicodeDecodeError:  # not whole characters
                self.byte[i] = True

    def __call__(self, words: list[str]) -> list[list[int]]:
        encode = self.model.encode_ordinary
        return [encode(f" {w}") for w in words]


def vocabulary(name: str, data: bytes):
    return Pieces(data) if name.endswith(".model") else Ranks(data)


@functools.cache
def script_of(letter: str) -> str:
    return unicodedata.name(letter, "other").split(" ")[0].split("-")[0]


def script_of_word(word: str) -> str | None:
    """The script of a word's first letter."""
    if "a" <= word[0] <= "z" or "A" <= word[0] <= "Z":
        return "LATIN"
    return next((script_of(c) for c in word if c.isalpha()), None)


class Lexicon:
    """Words that were taken apart: numbers for words, and for each vocabulary the tokens of all of them, one after another."""

    def __init__(self, vocabularies: Sequence) -> None:
        self.vocabularies = vocabularies
        self.scripts: dict[str | None, int] = {None: 0}
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars, self.hash, self.script = (np.empty(0, t) for t in (np.int64, np.uint64, np.int64))
        self.tokens = [np.empty(0, np.int32) for _ in self.vocabularies]
        self.starts = [np.zeros(1, np.int64) for _ in self.vocabularies]

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, word number) of all words of ``texts`` in order."""
        import xxhash

        if len(self.number) > KNOWN:
            self._clear()
        known, new, at, n = self.number, [], [], []
        for i, text in enumerate(texts):
            size = 0
            for piece in _stretches(text or ""):
                found = WORD.findall(piece)
                fresh = list(set(found).difference(known))
                known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                new += fresh
                n.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                size += len(found)
            at.append(np.full(size, i, np.int64))
        if new:
            self.chars = np.append(self.chars, np.fromiter(map(len, new), np.int64, len(new)))
            self.hash = np.append(self.hash, np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in new], np.uint64))
            self.script = np.append(self.script, [self.scripts.setdefault(script_of_word(w), len(self.scripts)) for w in new])
            for v, take in enumerate(self.vocabularies):
                ids = _in_sections(take, new)
                ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) + self.starts[v][-1]
                self.tokens[v] = np.append(self.tokens[v], np.fromiter(chain.from_iterable(ids), np.int32, ends[-1] - self.starts[v][-1]))
                self.starts[v] = np.append(self.starts[v], ends)
        return (np.concatenate(at), np.concatenate(n)) if n else (np.empty(0, np.int64), np.empty(0, np.int32))

    def tokens_of(self, v: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of these words one after another, how many each word has)."""
        start = self.starts[v][number]
        size = self.starts[v][number + 1] - start
        end = np.cumsum(size)
        return self.tokens[v][np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)], size


def _stretches(text: str, size: int = 1 << 18) -> Iterator[str]:
    """The text in pieces that are cut at white space."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and text[end] not in BLANK:
            end += 1
        yield text[at:end]
        at = end


def _in_sections(take, words: list[str]) -> list[list[int]]:
    """The tokens of each word; of long words section by section."""
    if all(len(w) <= SECTION for w in words):
        return take(words)
    parts = [[w[i : i + SECTION] for i in range(0, len(w), SECTION)] for w in words]
    ids = iter(take([x for p in parts for x in p]))
    return [[t for _ in p for t in next(ids)] for p in parts]


def repeated_words(at: np.ndarray, hashes: np.ndarray, texts: int) -> np.ndarray:
    """For each text the words in windows of WINDOW words that it has twice or more."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(texts, np.int64)
    whole = at[:n] == at[WINDOW - 1 :]
    sums = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        sums += mix(hashes[j : j + n] + np.uint64(j)) * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
    first = np.flatnonzero(whole)
    _, which, count = np.unique(mix(sums[first] + mix(at[first].astype(np.uint64))), return_inverse=True, return_counts=True)
    again = first[count[which] > 1]
    edge = np.zeros(len(hashes) + 1, np.int64)
    edge[again] += 1
    np.add.at(edge, again + WINDOW, -1)
    return np.bincount(at[np.cumsum(edge[:-1]) > 0], minlength=texts)


def _entropy(at: np.ndarray, tokens: np.ndarray, texts: int) -> np.ndarray:
    """The entropy in bits of each text's tokens."""
    pair, count = np.unique(at << np.int64(32) | tokens.astype(np.int64), return_counts=True)
    of = pair >> np.int64(32)
    total = np.bincount(at, minlength=texts)
    share = count / total[of]
    return np.bincount(of, -share * np.log2(share), minlength=texts)


def measure(texts: list[str | None], lexicon: Lexicon) -> dict[str, list | np.ndarray]:
    """Columns of BASE_SCHEMA for whole texts."""
    n = len(texts)
    at, number = lexicon.numbers(texts)
    number = number.astype(np.int64)
    words = np.bincount(at, minlength=n)
    chars = np.bincount(at, lexicon.chars[number], minlength=n).astype(np.int64)
    scripts = sorted(((s or "", k) for s, k in lexicon.scripts.items()))
    by_script = np.zeros((n, len(scripts)), np.int64)
    np.add.at(by_script, (at, lexicon.script[number]), 1)
    by_script[:, 0] = 0  # words without letters
    most = by_script[:, [k for _, k in scripts]].argmax(axis=1)
    script = [scripts[m][0] or "none" for m in most.tolist()]
    lines = [[x for x in t.split("\n") if x.strip(BLANK)] if t else [] for t in texts]
    bins, values, length = [], [], None
    for v, kind in enumerate(lexicon.vocabularies):
        tokens, size = lexicon.tokens_of(v, number)
        of = np.repeat(at, size)
        total = np.bincount(of, minlength=n)
        length = np.log2(np.maximum(total, 1)).astype(np.int32) if length is None else length
        safe = np.maximum(total, 1)
        real = (chars / safe, np.bincount(of, kind.byte[tokens], minlength=n) / safe, _entropy(of, tokens, n))
        values += real
        bins += [np.floor(np.log2(np.maximum(real[0], 2.0**-10)) * BINS[0]), np.floor(real[1] * BINS[1]), np.floor(real[2] * BINS[2])]
    return {
        "n_words": words,
        "word_chars": chars,
        "n_symbols": [sum(map(t.count, SYMBOLS)) if t else 0 for t in texts],
        "n_dup_lines": [len(x) - len(set(x)) for x in lines],
        "n_repeat_words": repeated_words(at, lexicon.hash[number], n),
        "script": script,
        "length": length,
        "bins": np.stack(bins, axis=1).astype(np.int32).tolist(),
        "measures": np.stack(values, axis=1).tolist(),
    }


def _measured(batches: Iterable[pa.RecordBatch], files: Sequence[tuple[str, bytes]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    lexicon = Lexicon([vocabulary(*f) for f in files])
    for batch in batches:
        for at, texts in portions(batch.column("text")):
            got = measure(texts, lexicon)
            kept = [batch.column(c).slice(at, len(texts)) for c in ("id", "lang")]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(got[f.name], f.type) for f in schema], names=["id", "lang", *schema.names])


_ARROW = pa.schema(
    [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64())]
    + [("script", pa.string()), ("length", pa.int32()), ("bins", pa.list_(pa.int32())), ("measures", pa.list_(pa.float64()))]
)


def measured_texts(docs: DataFrame, vocabularies: Sequence[str], id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    """(id, lang, and BASE_SCHEMA) for each row; ``vocabularies`` are paths that the driver reads."""
    files = [(path, open(path, "rb").read()) for path in vocabularies]
    sent = docs.sparkSession.sparkContext.broadcast(files)  # some hundred KB each, whatever the input
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _measured(b, sent.value, _ARROW), f"id {kind}, lang string, {BASE_SCHEMA}")


def bands(measured: DataFrame, measures: int, least: int) -> DataFrame:
    """(kind, length, n, low, high): a group's texts, and for each measure the lowest and highest bin that stays."""
    each = measured.groupBy("kind", "length").agg(F.count(F.lit(1)).alias("n"))
    hist = measured.select("kind", "length", F.posexplode("bins").alias("m", "bin")).groupBy("kind", "length", "m", "bin").agg(F.count(F.lit(1)).alias("n"))

    def quartiles(keys: list[str], name: str) -> DataFrame:
        sums = hist.groupBy(*keys, "m", "bin").agg(F.sum("n").alias("n"))
        whole = W.partitionBy(*keys, "m")
        upto = F.sum("n").over(whole.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
        placed = sums.withColumns({"upto": upto, "all": F.sum("n").over(whole)})
        at = [F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("bin"))) for q in (1, 2, 3)]
        below, above = (F.element_at(F.array(*map(F.lit, x)), F.col("m") % len(MEASURES) + 1) for x in (LEAST_BELOW, LEAST_ABOVE))
        found = placed.where(F.col("all") >= least).groupBy(*keys, "m").agg(*(x.alias(f"q{i + 1}") for i, x in enumerate(at)))
        told = F.lit("length" in keys) | (F.col("m") % len(MEASURES) != MEASURES.index("entropy"))
        low = F.when(told, F.col("q2") - F.greatest(REACH * (F.col("q2") - F.col("q1")), below)).otherwise(-OPEN)
        high = F.when(told, F.col("q2") + F.greatest(REACH * (F.col("q3") - F.col("q2")), above)).otherwise(OPEN)
        ordered = F.sort_array(F.collect_list(F.struct("m", low.alias("low"), high.alias("high"))))  # one for each measure
        return found.groupBy(*keys).agg(ordered.alias(name)).where(F.size(name) == measures)

    fine, coarse = quartiles(["kind", "length"], "b0"), quartiles(["kind"], "b1")
    every = quartiles([], "b2")
    met = each.join(fine, ["kind", "length"], "left").join(coarse, "kind", "left").join(F.broadcast(every), F.lit(True), "left")  # one row
    band = F.coalesce("b0", "b1", "b2")
    return met.select("kind", "length", "n", band["low"].alias("low"), band["high"].alias("high"))


def _rejected(vocabularies: int) -> Column:
    """The first measure that is outside of its band by all vocabularies, else null."""

    def outside(m: int) -> Column:
        one = [(F.col("bins")[i] < F.col("low")[i]) | (F.col("bins")[i] > F.col("high")[i]) for i in range(m, vocabularies * len(MEASURES), len(MEASURES))]
        return functools.reduce(Column.__and__, one)

    return F.coalesce(*(F.when(outside(m), F.lit(name)) for m, name in enumerate(MEASURES)))


def fertility_rules(
    docs: DataFrame,
    vocabularies: Sequence[str] = tuple(f"{FOLDER}/{v}" for v in VOCABULARIES),
    least: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str | None = "lang",
) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, reason, measures) for each row.

    ``measures`` has MEASURES for each vocabulary; ``reason`` names the base rules or the measure that rejects.
    """
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    kind = F.when(F.col("lang").isNotNull(), F.concat(F.lit("language "), "lang")).otherwise(F.concat(F.lit("script "), "script"))
    measured = measured_texts(docs, vocabularies, id_col, text_col, lang_col).withColumns({"base_failed": failed, "kind": kind})
    measured = cut(measured)
    good = measured.where("not base_failed")
    facts = bands(good, len(MEASURES) * len(vocabularies), least)
    judged = join_by_key(good, facts, ["kind", "length"], "n", hot_bar(good.count())).withColumn("reason", _rejected(len(vocabularies)))
    rest = measured.where("base_failed").withColumns({"low": F.lit(None).cast("array<int>"), "high": F.lit(None).cast("array<int>"), "reason": F.lit("base")})
    out = judged.unionByName(rest)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select(F.col("id").alias(id_col), *counts, "base_failed", F.col("reason").isNull().alias("kept"), "reason", "measures")
