"""Vectorised text helpers that run inside Spark's Arrow tasks.

Texts are handled as arrays of code points, whole, in slabs of bounded size: a longer text is cut where a word cannot
be (at white space), so no word is split and memory does not follow the longest text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLAB = 1 << 18
PORTION = 1 << 20
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = 2 * SLAB + 64
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for step in (_BASE, inverse):
        p = np.full(n, step, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def slabs(texts: list[str | None]) -> Iterator[tuple[np.ndarray, str]]:
    """(row number of every piece's start, joined text) of at most about SLAB code points; rows end in a newline.

    Yields pairs (rows, text): ``rows`` is an array of (row, first position in the slab, offset in the row's text).
    """
    rows: list[tuple[int, int, int]] = []
    parts: list[str] = []
    size = 1
    for i, text in enumerate(texts):
        if not text:
            continue
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > SLAB:
                found = _SPACE.search(text, at + SLAB)
                end = found.start() + 1 if found else end
            if parts and size + end - at > SLAB:
                yield np.array(rows, np.int64), "\n" + "".join(parts)
                rows, parts, size = [], [], 1
            rows.append((i, size, at))
            parts += [text[at:end], "\n"]
            size += end - at + 1
            at = end
    if parts:
        yield np.array(rows, np.int64), "\n" + "".join(parts)


def portions(column: pa.Array, size: int = PORTION) -> Iterator[tuple[int, list[str | None]]]:
    """Texts of consecutive rows, about ``size`` bytes at a time, with the number of their first row."""
    length = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(length, dtype=np.int64) - length) // size
    edge = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
    for at, to in zip(edge[:-1], edge[1:], strict=True):
        if at < to:
            yield at, column.slice(at, to - at).to_pylist()


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the first and last element are False."""
    at = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    return at[0::2], at[1::2]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span of code values: the same wherever the span stands."""
    v = (values.astype(np.uint64) + np.uint64(1)) * _M2
    v ^= v >> np.uint64(32)
    n = len(v)
    if n + 1 > len(_powers()[0]):  # one word longer than a slab: hash it with powers made for it
        out = np.empty(len(starts), np.uint64)
        for k, (s, e) in enumerate(zip(starts, ends, strict=True)):
            h = np.uint64(0)
            for b in range(int(s), int(e), SLAB):
                piece = v[b : min(int(e), b + SLAB)]
                part = np.add.reduce(piece * _powers()[0][: len(piece)], dtype=np.uint64)
                shift = np.uint64(pow(int(_BASE), b - int(s), 1 << 64))
                h = np.uint64((int(h) + int(part) * int(shift)) & 0xFFFFFFFFFFFFFFFF)
            out[k] = h
        return mix(out ^ (ends - starts).astype(np.uint64))
    up, down = _powers()
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(v * up[:n], out=total[1:])
    return mix(((total[ends] - total[starts]) * down[starts]) ^ (ends - starts).astype(np.uint64))


@functools.cache
def space_table() -> np.ndarray:
    """True for the code points that part words in the contracts: U+0020 and U+0009 to U+000D."""
    t = np.zeros(0x110000, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


@functools.cache
def letter_table() -> np.ndarray:
    """True for letters (Unicode category L)."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@functools.cache
def lower_table() -> np.ndarray:
    """Simple lower-case mapping; characters whose lower case has several code points stay."""
    out = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i).lower()
        if len(c) == 1:
            out[i] = ord(c)
    return out


def words(texts: list[str | None], fold: str = "ascii") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) arrays of the words ``[^\\x20\\x09-\\x0D]+`` of whole texts, in order; A-Z folded to lower case."""
    for rows, text in slabs(texts):
        cp = code_points(text)
        s, e = runs(~space_table()[cp])
        if fold == "ascii":
            cp = np.where((cp >= 65) & (cp <= 90), cp + np.uint32(32), cp)
        h = span_hashes(cp, s, e)
        yield rows[np.searchsorted(rows[:, 1], s, side="right") - 1, 0], h


def row_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows joined, and the n + 1 offsets of the rows."""
    got = list(words(texts))
    if not got:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    row, h = (np.concatenate(x) for x in zip(*got, strict=True))
    return h, np.searchsorted(row, np.arange(len(texts) + 1))


_PLACE = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(64)]


def shingles(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of every row (not distinct), and the rows' offsets.

    A row with fewer than k words, but some, has one: its whole sequence.
    """
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    to = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(to[-1], np.uint64)
    if len(h) >= k:
        full = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            full += h[j : len(h) - k + 1 + j] * _PLACE[j]
        keep = np.zeros(len(full) + 1, np.int64)
        long = n >= k
        np.add.at(keep, at[:-1][long], 1)
        np.add.at(keep, at[1:][long] - k + 1, -1)
        inside = np.cumsum(keep[:-1]) > 0
        where = np.zeros(to[-1] + 1, bool)
        where[to[:-1][(count == 1) & (n < k)]] = True
        out[~where[:-1]] = mix(full[inside])
    for r in np.flatnonzero((n > 0) & (n < k)):
        words_ = h[at[r] : at[r + 1]]
        one = np.add.reduce(words_ * np.array(_PLACE[: len(words_)], np.uint64), dtype=np.uint64)
        out[to[r]] = mix(np.array([one ^ np.uint64(len(words_) * 0x51ED27)], np.uint64))[0]
    return out, to


class HashIndex:
    """A static table from 64-bit hashes to their row numbers, looked up many at a time; -1: absent."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        size = 1 << self.bits
        self.keys, self.rows = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.rows[slot] < 0
            take, first = np.unique(slot[free], return_index=True)
            won = left[free][first]
            self.rows[take], self.keys[take] = won, keys[won]
            lost = np.ones(len(left), bool)
            lost[np.flatnonzero(free)[first]] = False
            left, slot = left[lost], (slot[lost] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        row = self.rows[slot]
        hit = (row >= 0) & (self.keys[slot] == keys)
        out = np.where(hit, row, -1)
        todo = np.flatnonzero((row >= 0) & ~hit)
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            row = self.rows[slot]
            hit = (row >= 0) & (self.keys[slot] == keys[todo])
            out[todo[hit]] = row[hit]
            more = (row >= 0) & ~hit
            todo, slot = todo[more], slot[more]
        return out
