import random
import re

import numpy as np
import pytest

from ironsieve.llm import jaccard_join
from ironsieve.llm.jaccard_join import jaccard_components
from ironsieve.llm.signature_tree import linked_pairs, similar
from ironsieve.operators.components import connected_components
from ironsieve.session import cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    """(id, n, component) by comparing all pairs."""
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x in range(len(sets)):
        for y in range(x):
            (i, a), (j, b) = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return sorted((i, len(s), root(i)) for i, s in sets)


def corpus(seed, n=160):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)]
    passage = r.choices(vocabulary, k=40)
    out = []
    while len(out) < n:
        words = r.choices(vocabulary, k=r.choice([1, 2, 3, 4, 5, 8, 30, 120]))
        if r.random() < 0.3:
            words += passage
        for _ in range(r.choice([1, 1, 2, 6])):
            copy = list(words)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary).upper()
            out.append("\t".join(copy))
    return list(enumerate(out))


@pytest.mark.parametrize("k,percent,blocks", [(4, 85, None), (5, 80, None), (3, 60, (300, 8))])
def test_same_as_brute_force(spark, monkeypatch, k, percent, blocks):
    if blocks:
        monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", blocks[0])
        monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", blocks[1])
        monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    rows = corpus(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in jaccard_components(docs, k, percent).collect())
    assert got == brute(rows, k, percent)


def test_large_groups(spark, monkeypatch):
    """Near copies of a few texts, chains of drifting copies and a passage that all share, over many small blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 12)
    r = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for base in range(3):
        words = passage + [f"b{base}x{i}" for i in range(30)]
        for k in range(60):
            copy = list(words)
            for _ in range(r.choice([0, 1, 1, 2, 5])):
                copy[r.randrange(len(copy))] = f"v{r.randrange(99)}"
            texts.append(" ".join(copy))
            if k % 6 == 0:
                words = copy + [f"d{r.randrange(999)}"]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert sorted(tuple(x) for x in got) == brute(rows, 5, 80)


def test_stars_have_few_edges_and_the_same_components(spark):
    r = random.Random(5)
    links = [(a, r.randrange(1, 20)) for a in range(1, 2_000) for _ in range(15)] + [(5_000 + a, 5_003 + a) for a in range(40)]
    df = spark.createDataFrame([(a, b) for a, b in links if a != b], "x long, b long")
    some = cut(jaccard_join.stars(df, "x", "b"))
    component = lambda e: {tuple(x) for x in connected_components(e).collect()}
    assert component(some) == component(df.withColumnRenamed("x", "a"))
    assert some.count() < 2_000 + 40 + 20 * 20


def test_hard_rows(spark):
    rows = [(5, None), (3, ""), (9, " \t\n"), (8, "One"), (2, "one"), (7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (1, "x " * 300_000), (4, "X " * 300_001)]
    docs = spark.createDataFrame([(i, t, i, "z") for i, t in rows], "doc_id long, text string, component long, node string")
    got = sorted((tuple(r) for r in jaccard_components(docs, 4, 85).collect()), key=str)
    want = [(5, 0, 5), (3, 0, 3), (9, 0, 9), (8, 1, 2), (2, 1, 2), (7, 2, 7), (7, 2, 7), (None, 2, None), (1, 1, 1), (4, 1, 1)]
    assert got == sorted(want, key=str)
    assert jaccard_components(docs.limit(0), 4, 85).collect() == []


def test_trees_find_what_all_pairs_find():
    r = np.random.default_rng(3)
    base = [np.unique(r.integers(0, 1 << 63, int(n)).astype(np.uint64)) for n in r.integers(1, 900, 60)]
    sets = [np.unique(np.concatenate([b[r.random(len(b)) > d], b[:1]])) for b in base for d in (0, 0.03, 0.1, 0.2)]
    own = np.arange(len(sets))

    def parts(pairs):
        up = list(range(len(sets)))

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for i, j in pairs:
            p, q = sorted((root(i), root(j)))
            up[q] = p
        return [root(i) for i in own]

    every = [(i, j) for i in own for j in own[:i] if similar(sets[i], sets[j], 80)]
    assert parts(linked_pairs(sets, own, None, 80)) == parts(every)
    left, right = own[::2], own[1::2]
    across = [(i, j) for i, j in every if (i + j) % 2]
    assert parts(linked_pairs(sets, left, right, 80)) == parts(across)
