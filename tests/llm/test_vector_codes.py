import hashlib
import math

import numpy as np
import pytest

from ironsieve.llm.vector_codes import DIGIT, Nearest, digits, scaled, vector_codes


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """{id: (code, error)}, {label: error}, sha in plain Python integers."""
    fine = [(i, [math.floor(scale * x) if abs(x) < 2**40 else int(x) * scale for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((r for r in fine if r[0] is not None), key=lambda r: (r[0], r[1]))
    step = len(first[0][1]) // parts
    cut = lambda v: [v[p * step : (p + 1) * step] for p in range(parts)]
    odd = [r for r in fine if len(r[1]) != step * parts]
    fine = [(i, cut(v), label) for i, v, label in fine if len(v) == step * parts]
    books = [[cut(r[1])[p] for r in first[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        got = [{} for _ in range(parts)]
        for _, v, _ in fine:
            for p in range(parts):
                got[p].setdefault(nearest(p, v[p])[1], []).append(v[p])
        books = [[[sum(c) // len(c) for c in zip(*got[p][k])] if k in got[p] else e for k, e in enumerate(books[p])] for p in range(parts)]
    out, sums = [(i, None, None, label) for i, _, label in odd], {}
    for i, v, label in fine:
        near = [nearest(p, v[p]) for p in range(parts)]
        error = sum(d for d, _ in near)
        out.append((i, "".join(f"{k:02x}" for _, k in near), error, label))
        sums[label] = sums.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, code, error, sums.get(label), sha) for i, code, error, label in out), key=repr)


def told(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=repr)


SCHEMA = "vec_id long, embedding array<double>, label int, code string, x int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA).repartition(3)


def test_against_plain_integers(spark):
    r = np.random.default_rng(2)
    rows = [(int(i), (r.normal(size=8).round(int(r.integers(1, 4)))).tolist(), int(r.integers(3)) if i % 7 else None) for i in r.permutation(700)]
    rows += [(900 + i, rows[5][1], 1) for i in range(150)]  # copies, so ties between entries
    rows += [(-1, None, 1), (-2, [math.nan] * 8, 1), (-3, [None] + [0.0] * 7, 1), (-4, [-math.inf] * 8, 1), (2000, [1.0] * 4, 9), (2001, [], 2), (None, [0.25] * 8, None)]
    assert told(vector_codes(frame(spark, rows))) == brute(rows)


def test_few_large_and_no_vectors(spark):
    few = [(1, [0.5, -0.5, 1 / 3, 2.0], 1), (1, [0.5, -0.5, 1 / 3, 1.0], 1), (2, [1e30, 0.0, -1e300, 1.0], None), (3, [0.0, 3e15, -2e20, 7.0], 1)]
    want = brute(few)
    fits = [(i, c, e if e is None or e < 2**63 else None, None, s) for i, c, e, _, s in want]
    assert [x[:3] + x[4:] for x in told(vector_codes(frame(spark, few)))] == [x[:3] + x[4:] for x in sorted(fits, key=repr)]
    assert vector_codes(frame(spark, few).limit(0)).collect() == []
    odd = [(1, [1.0, 2.0, 3.0], 1), (2, [1.0] * 4, 1)]
    assert told(vector_codes(frame(spark, odd))) == [(1, None, None, None, None), (2, None, None, None, None)]
    assert [r.code for r in vector_codes(frame(spark, [(1, [], 1)])).collect()] == ["00000000"]


def test_hot_label_and_long_vectors(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.integers(-3, 4, 1024).astype(float).tolist(), 0 if i % 3 else i) for i in range(60)]
    assert told(vector_codes(frame(spark, rows), entries=8, rounds=1)) == brute(rows, entries=8, rounds=1)


@pytest.mark.parametrize("kind", ["grid", "normal", "copies"])
def test_tree_finds_the_lowest_of_the_nearest(kind):
    r = np.random.default_rng(7)
    make = {"grid": lambda n: r.integers(-2, 3, (n, 4)), "normal": lambda n: (r.normal(size=(n, 4)) * 300).astype(np.int64), "copies": lambda n: r.integers(0, 2, (n, 4)) * 1000}[kind]
    entries, parts = make(256).astype(np.int64), make(2000).astype(np.int64)
    find = Nearest(entries)
    place, best = find(parts)
    d = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (place == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert find.compared < 0.6 * d.size  # balls were left out


def test_digits_and_scaling():
    for n in (0, 5, -7, 1 << 70, -(1 << 200) + 3):
        assert sum(d << (DIGIT * i) for i, d in enumerate(digits(n))) == n
    assert scaled(np.array([-0.1, 0.1, -1 / 1024, 1e300]), 1024).tolist() == [-103, 102, -1, int(1e300) * 1024]
