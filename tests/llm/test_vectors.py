"""Whitening and codes of vectors against plain loops in exact arithmetic."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from moundworks.llm import codes, whitening

COLUMNS = "vec_id long, embedding array<double>, label int, x int, size int, block int, code int"


def rows_of(n, size, seed=0):
    r = random.Random(seed)
    return [(i, [r.gauss(0.3 * (d % 5), 1.0 + d % 3) for d in range(size)], r.choice([0, 1, None]), 1, 2, 3, 4) for i in range(n)]


def spoilt(size):
    return [(900, None, 1, 1, 2, 3, 4), (901, [1.0] * (size - 1) + [None], 1, 1, 2, 3, 4), (902, [math.nan] * size, 1, 1, 2, 3, 4), (903, [math.inf] + [0.0] * (size - 1), 0, 1, 2, 3, 4)]


def test_limbs_and_grams_are_exact():
    r = random.Random(1)
    y = np.array([[r.randint(-(1 << b), 1 << b) for b in (3, 17, 18, 40, 62)] for _ in range(50)])
    sums, products = whitening.gram(y)
    big = [[int(v) for v in row] for row in y]
    assert sums.tolist() == [sum(row[j] for row in big) for j in range(5)]
    assert products.tolist() == [[sum(row[i] * row[j] for row in big) for j in range(5)] for i in range(5)]
    for d in whitening.limbs(y):
        assert d.min() >= -(1 << 17) and d.max() < 1 << 17
    m = whitening.Moments(5, 1000)
    m.add(y[:20])
    m.add(y[20:])
    assert m.products.tolist() == [[sum((row[i] - 1000) * (row[j] - 1000) for row in big) for j in range(5)] for i in range(5)]


def test_whitening_is_that_of_distinct_vectors(spark):
    some = rows_of(80, 20)
    copies = [(200 + i, some[0][1], 5, 1, 2, 3, 4) for i in range(40)] + [some[1], (None, some[2][1], 1, 1, 2, 3, 4)]
    df = spark.createDataFrame([*some, *copies, *spoilt(20), (950, [], 0, 1, 2, 3, 4)], COLUMNS).repartition(5)
    got = whitening.whiten(df).collect()
    kept = [*some, *copies]
    ints = [[math.floor(64 * c) + 1_000_000 for c in v[1]] for v in kept]
    fit = sorted(set(map(tuple, ints)))
    n, s = len(fit), [sum(v[d] for v in fit) for d in range(20)]
    assert {r.n for r in got} == {n} and len(got) == 16 * len(kept)
    assert sorted((r.component for r in got)) == sorted(list(range(1, 17)) * len(kept))
    cov = np.array([[float(sum(Fraction(n * v[i] - s[i]) * (n * v[j] - s[j]) for v in fit) / n**3) for j in range(20)] for i in range(20)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    by_id = {}
    for v, row in zip(kept, ints, strict=True):
        y = np.array([float(Fraction(n * a - b, n)) for a, b in zip(row, s, strict=True)])
        by_id.setdefault(v[0], []).append((sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)), y @ axes[:, :16] / np.sqrt(values[:16])))
    sign = {}
    for r in got:
        want = by_id[r.vec_id][0]
        assert r.deviation == want[0] and r.deviation_digits == str(want[0])
        w = want[1][r.component - 1]
        if abs(w) > 1e-6:
            assert sign.setdefault(r.component, np.sign(w * r.whitened)) == np.sign(w * r.whitened)
        assert abs(r.whitened) == pytest.approx(abs(w), rel=1e-8, abs=1e-9)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert r.identity_error < 1e-9


def test_whitening_of_little(spark):
    assert whitening.whiten(spark.createDataFrame([], COLUMNS)).count() == 0
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, 0, 0, 0, 0)] * 3, COLUMNS)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in sorted(got, key=lambda r: r.component)] == [(1, k, 1, 0, None, None) for k in (1, 1, 1, 2, 2, 2)]
    two = [(1, [0.0, 0.0], 0, 0, 0, 0, 0), (2, [1.0, 1.0], 0, 0, 0, 0, 0), (3, [1.0], 0, 0, 0, 0, 0), (4, [3.0], 0, 0, 0, 0, 0), (5, [1e300], 0, 0, 0, 0, 0)]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(spark.createDataFrame(two, COLUMNS)).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1), (5, 1)}
    assert abs(got[1, 1].whitened) == pytest.approx(1) and got[1, 2].whitened is None and got[1, 2].explained == 0
    assert got[5, 1].deviation is None and int(got[5, 1].deviation_digits) > 1 << 63
    with pytest.raises(ValueError, match="lengths"):
        whitening.whiten(spark.createDataFrame(two, COLUMNS), most_sizes=1)


def plain_codes(kept, parts=8, entries=16, rounds=6):
    ints = [[math.floor(4096 * c) for c in v] for _, v, _ in kept]
    step = len(ints[0]) // parts
    first = {}
    for (i, _, _), v in zip(kept, ints, strict=True):
        if i is not None:
            first[i] = min(first.get(i, v), v)
    starts = [first[i] for i in sorted(first)[:entries]]
    cut = lambda v, p: v[p * step : (p + 1) * step]
    books = [[cut(v, p) for v in starts] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(cut(v, p), books[p])[1] for v in ints]
            groups = [[cut(v, p) for v, k in zip(ints, own, strict=True) if k == e] for e in range(len(books[p]))]
            books[p] = [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else b for g, b in zip(groups, books[p], strict=True)]
    found = [[nearest(cut(v, p), books[p]) for p in range(parts)] for v in ints]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    label = {}
    for f, (_, _, k) in zip(found, kept, strict=True):
        label[k] = label.get(k, 0) + sum(d for d, _ in f)
    return [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), label[k], sha) for f, (i, _, k) in zip(found, kept, strict=True)]


def order(r):
    return tuple((x is not None, x) for x in r)


def test_codes_follow_a_plain_loop(spark):
    some = rows_of(150, 24, seed=3)
    more = [some[0], (None, some[4][1], None, 1, 2, 3, 4), (3, [0.0] * 24, None, 1, 2, 3, 4)] + [(300 + i, some[7][1], 1, 1, 2, 3, 4) for i in range(30)]
    df = spark.createDataFrame([*some, *more, *spoilt(24)], COLUMNS).repartition(4)
    got = codes.quantise(df, block_rows=16)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = plain_codes([r[:3] for r in [*some, *more]])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)


def test_codes_of_little(spark):
    assert codes.quantise(spark.createDataFrame([], COLUMNS)).count() == 0
    few = [(5, [1.0] * 8, 1, 0, 0, 0, 0), (2, [2.0] * 8, None, 0, 0, 0, 0), (2, [2.0] * 8, None, 0, 0, 0, 0)]
    odd = [(7, [1.0] * 9, 1, 0, 0, 0, 0), (8, [], None, 0, 0, 0, 0), (None, [1.0] * 16, 1, 0, 0, 0, 0)]
    got = sorted(map(tuple, codes.quantise(spark.createDataFrame([*few, *odd], COLUMNS)).collect()), key=order)
    want = plain_codes([r[:3] for r in few])
    whole = {k: e for (_, _, k), (*_, e, _) in zip([r[:3] for r in few], want, strict=True)}
    assert got == sorted([*want, (7, None, None, whole[1], None), (8, None, None, whole[None], None), (None, None, None, whole[1], None)], key=order)
    for v, fits in ((1e5, True), (1e9, False)):
        far = [(1, [v] * 8, 1, 0, 0, 0, 0), (2, [-v] * 8, 1, 0, 0, 0, 0), (3, [0.1 * v] * 8, 1, 0, 0, 0, 0)]
        got = sorted(map(tuple, codes.quantise(spark.createDataFrame(far, COLUMNS), entries=2).collect()), key=order)
        want = [(i, c, e if e < 1 << 63 else None, w if fits else None, h) for i, c, e, w, h in plain_codes([r[:3] for r in far], entries=2)]
        assert got == sorted(want, key=order)


def test_only_changed_parts_move():
    x = np.arange(12).reshape(3, 4)
    old, new = np.array([[0, 1], [1, 1], [0, 0]], np.uint8), np.array([[0, 0], [1, 1], [1, 0]], np.uint8)
    got = {(d["part"], d["entry"]): (d["n"], d["sums"]) for d in codes.changes(4, x, old, new)}
    assert got == {(0, 1): (1, [8, 9]), (0, 0): (-1, [-8, -9]), (1, 0): (1, [2, 3]), (1, 1): (-1, [-2, -3])}
    assert codes.changes(4, x, new, new) == []
