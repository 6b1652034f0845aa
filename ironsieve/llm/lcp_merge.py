"""Sorted runs that carry longest common prefixes, a loser tree that merges them, and a path stack that makes trie nodes.

Sequences are bytes of whole units of 16; longest common prefixes (LCP) count units. Only Spark's tasks use this: see
conversation_trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

UNIT = 16


@dataclass(slots=True)
class Record:
    """One distinct sequence: its bytes, the weight of each unit, how many stand for it, the smallest, and what hangs
    below its end (children, leaves, saved) from elsewhere."""

    key: bytes
    weights: list[int]
    n: int
    least: int
    below: tuple[int, int, int] = (0, 0, 0)


def common(a: bytes, b: bytes, units: int = 0) -> int:
    """The LCP of two sequences that agree in their first ``units`` units."""
    most = min(len(a), len(b)) // UNIT
    while units < most and a[units * UNIT : (units + 1) * UNIT] == b[units * UNIT : (units + 1) * UNIT]:
        units += 1
    return units


def sorted_run(records: list[Record]) -> Iterator[tuple[int, Record]]:
    """The records in order, each with its LCP with the one before."""
    last = b""
    for r in sorted(records, key=lambda r: r.key):
        yield common(last, r.key), r
        last = r.key


@dataclass
class Cursor:
    """A run as far as it has been read: (LCP, record) pairs still to come."""

    items: list[tuple[int, Record]] = field(default_factory=list)
    at: int = 0
    lcp: int = 0

    @property
    def record(self) -> Record | None:
        return self.items[self.at][1] if self.at < len(self.items) else None

    def advance(self) -> None:
        self.at += 1
        if self.at < len(self.items):
            self.lcp = self.items[self.at][0]
        else:
            self.items, self.at = [], 0


class LoserTree:
    """Merges cursors. A cursor's LCP is that with the record put out last; a loser's, with what has beaten it.

    Of two candidates the one with the longer LCP is the smaller, without a look at either; only for equal LCPs are
    units compared, from there on, so no unit that the candidates share with earlier output is compared again.
    """

    def __init__(self) -> None:
        self.cursors: list[Cursor] = []
        self.losers: list[int] = []
        self.winner = -1
        self.compared = 0

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser)."""
        x, y = self.cursors[a], self.cursors[b]
        if x.record is None or y.record is None:
            return (b, a) if x.record is None else (a, b)
        if x.lcp != y.lcp:
            return (a, b) if x.lcp > y.lcp else (b, a)
        same = common(x.record.key, y.record.key, x.lcp)
        self.compared += same - x.lcp + 1
        won, lost = (a, b) if x.record.key <= y.record.key else (b, a)
        self.cursors[lost].lcp = same
        return won, lost

    def build(self, last: bytes) -> None:
        """Start again after ``last`` was put out, as when a run has got more records."""
        for c in self.cursors:
            if c.record is not None:
                c.lcp = common(last, c.record.key)
        k = len(self.cursors)
        self.losers, up = [-1] * k, [-1] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            up[node], self.losers[node] = self._play(up[2 * node], up[2 * node + 1])
        self.winner = up[1] if k > 1 else k - 1

    def next(self) -> None:
        """Replace the winner by its run's next record and play its path again."""
        won = self.winner
        self.cursors[won].advance()
        node = (won + len(self.cursors)) // 2
        while node:
            won, self.losers[node] = self._play(won, self.losers[node])
            node //= 2
        self.winner = won

    @property
    def top(self) -> Cursor | None:
        return self.cursors[self.winner] if self.winner >= 0 and self.cursors[self.winner].record is not None else None


def merged(blocks: Iterable[tuple[int, bytes, list[tuple[int, Record]]]], tree: LoserTree | None = None) -> Iterator[tuple[int, Record]]:
    """(LCP with the one before, record) of all runs in order.

    ``blocks``, (run, first key, records), are pieces of runs in the order of their first keys. A block is read when its
    first key is due, so the memory is that of one block for each run.
    """
    tree = tree or LoserTree()
    rest, of, last = iter(blocks), {}, b""
    block = next(rest, None)
    while True:
        top = tree.top
        if block is not None and (top is None or block[1] <= top.record.key):
            run, _, items = block
            if run not in of:
                of[run] = Cursor()
                tree.cursors.append(of[run])
            c = of[run]
            c.items, c.at = c.items[c.at :] + items, 0
            tree.build(last)
            block = next(rest, None)
        elif top is None:
            return
        else:
            r, last = top.record, top.record.key
            yield top.lcp, r
            tree.next()


@dataclass(slots=True)
class Node:
    key: bytes
    parent: bytes | None
    depth: int
    words: int
    went_on: bool  # it was open in the range before
    hasher: object
    n: int = 0
    least: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    shared: bool = False

    def add(self, n: int, least: int | None, leaves: int, saved: int) -> None:
        self.n += n
        if least is not None:
            self.least = least if self.least is None else min(self.least, least)
        self.leaves += leaves
        self.saved += saved


def nodes(stream: Iterable[tuple[int, Record]], before: int = 0, after: int = 0) -> Iterator[Node]:
    """Trie nodes of a merged stream, each when the stream has left its subtree; the stack holds the open path only.

    The first unit of every sequence is the key of the node where it hangs. ``before`` and ``after`` are the LCPs of
    the stream's first and last record with the records before and after the stream: nodes on these ends are ``shared``
    and partial, and the sums of their parts are the whole node's. A node's children, and the one that its ``saved``
    leaves out, count where it begins; only a node that ends inside of the stream can be a leaf.
    """
    path: list[Node] = []
    first = True

    def close(is_open: bool) -> Node:
        done = path.pop()
        done.leaves += not (done.children or done.went_on or is_open)  # what went on has children here
        done.saved += done.n * done.words - (0 if done.went_on else done.words)
        done.shared = done.went_on or is_open
        if path:
            path[-1].add(done.n, done.least, done.leaves, done.saved)
        return done

    for lcp, r in stream:
        while len(path) > (0 if first else lcp):
            yield close(False)
        for u in range(len(path), len(r.key) // UNIT):
            unit = r.key[u * UNIT : (u + 1) * UNIT]
            hasher = path[-1].hasher.copy() if path else hashlib.sha256()
            hasher.update(unit)
            went_on = first and u < before
            key = hasher.digest()[:UNIT] if u else unit
            if path:
                path[-1].children += not went_on
            path.append(Node(key, path[-1].key if path else None, u, r.weights[u - 1] if u else 0, went_on, hasher))
        children, leaves, saved = r.below
        path[-1].add(r.n, r.least, leaves, saved)
        path[-1].children += children
        first = False
    while path:
        yield close(len(path) <= after)
