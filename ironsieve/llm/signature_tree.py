"""Signature trees: sets in a hierarchy whose nodes hold OR-combined token bitmaps and size ranges.

A dual traversal walks two trees at once (or one with itself) and drops a pair of nodes when no member of one can share
enough with a member of the other. The bound is rigorous: a set x below node A has at most
|x| - bits(x) elements besides one for each of its bits, and only bits that B's bitmap also has can be shared, so
overlap <= slack(A) + bits(A & B), likewise for B, and overlap <= the larger size of either.
"""

from __future__ import annotations

import numpy as np

from ironsieve.llm.embedding_dedup import Sets
from ironsieve.llm.textvec import mix

FAN = 8


def bitmap_width(largest: int) -> int:
    return 1 << min(16, max(8, int(2 * largest).bit_length()))


def bitmaps(sets: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(sets), width // 64), np.uint64)
    shift = np.uint64(64 - (width.bit_length() - 1))
    for at in range(0, len(sets), 64):
        part = sets[at : at + 64]
        grid = np.zeros((len(part), width), bool)
        row = np.repeat(np.arange(len(part)), [len(s) for s in part])
        grid[row, (mix(np.concatenate(part)) >> shift).astype(np.int64)] = True
        out[at : at + 64] = np.packbits(grid, axis=1).view(np.uint64)
    return out


class Tree:
    """Levels from the sets (0) to one root. ``order`` are the sets' numbers, like next to like."""

    def __init__(self, sets: list[np.ndarray], numbers: np.ndarray, width: int):
        size = np.array([len(sets[i]) for i in numbers], np.int64)
        least = np.array([sets[i][0] for i in numbers], np.uint64)
        self.order = numbers[np.lexsort((least, np.log2(size).astype(np.int64) if len(size) else size))]
        own = [sets[i] for i in self.order]
        bits = bitmaps(own, width)
        size = np.array([len(s) for s in own], np.int64)
        self.levels = [(bits, size, size, size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1][1]) > 1:
            self.grow()

    def grow(self) -> None:
        bits, lo, hi, slack = self.levels[-1]
        at = np.arange(0, len(lo), FAN)
        self.levels.append(
            (
                np.bitwise_or.reduceat(bits, at),
                np.minimum.reduceat(lo, at),
                np.maximum.reduceat(hi, at),
                np.maximum.reduceat(slack, at),
            )
        )


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = shared(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def linked_pairs(
    sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, percent: int
) -> list[tuple[int, int]]:
    """Pairs of set numbers that span the components of the link graph: {i, j} is a link if their Jaccard similarity
    is ``percent`` hundredths or more. ``right`` None: links inside ``left``, else only those between the two.

    Sets are sorted, distinct and not empty. A pair whose members are joined already isn't looked at again, so a large
    group of near copies costs about one exact check for each member.
    """
    if not len(left) or (right is not None and not len(right)):
        return []
    width = bitmap_width(max(len(sets[i]) for x in (left, right) if x is not None for i in x))
    one = Tree(sets, left, width)
    two = one if right is None else Tree(sets, right, width)
    while len(one.levels) < len(two.levels):
        one.grow()
    while len(two.levels) < len(one.levels):
        two.grow()
    seen, found = Sets(len(sets)), []
    chunk = max(16, (1 << 22) // (width // 8) // FAN**2)
    kids = np.arange(FAN)
    top = len(one.levels) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        limit = chunk if level else chunk * FAN**2
        if len(i) > limit:
            stack.append((level, i[limit:], j[limit:]))
            i, j = i[:limit], j[:limit]
        (bi, lo_i, hi_i, slack_i), (bj, lo_j, hi_j, slack_j) = one.levels[level], two.levels[level]
        if not level:
            root = np.array([seen.root(int(k)) for k in one.order])
            other = root if two is one else np.array([seen.root(int(k)) for k in two.order])
            apart = root[i] != other[j]
            if two is one:
                apart &= i != j
            i, j = i[apart], j[apart]
        need = -(-percent * (lo_i[i] + lo_j[j]) // (100 + percent))
        fits = (100 * hi_i[i] >= percent * lo_j[j]) & (100 * hi_j[j] >= percent * lo_i[i])
        i, j, need = i[fits], j[fits], need[fits]
        both = np.bitwise_count(bi[i] & bj[j]).sum(axis=1, dtype=np.int64)
        most = np.minimum(np.minimum(hi_i[i], hi_j[j]), both + np.minimum(slack_i[i], slack_j[j]))
        keep = most >= need
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if level:
            ci = (i[:, None, None] * FAN + kids[None, :, None]).repeat(FAN, axis=2).ravel()
            cj = (j[:, None, None] * FAN + kids[None, None, :]).repeat(FAN, axis=1).ravel()
            fine = (ci < len(one.levels[level - 1][1])) & (cj < len(two.levels[level - 1][1]))
            if two is one:
                fine &= ci <= cj
            ci, cj = ci[fine], cj[fine]
            same = ci == cj if two is one else np.zeros(len(ci), bool)
            stack.append((level - 1, ci[~same], cj[~same]))
            if same.any():  # first, as what it joins saves work elsewhere
                stack.append((level - 1, ci[same], cj[same]))
            continue
        for x, y in zip(one.order[i].tolist(), two.order[j].tolist(), strict=True):
            if seen.root(x) != seen.root(y) and similar(sets[x], sets[y], percent):
                seen.join(x, y)
                found.append((x, y))
    return found

