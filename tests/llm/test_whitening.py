"""Whitening against numpy and exact whole-number sums."""

from itertools import combinations_with_replacement

import numpy as np
import pytest
from pyspark.sql import types as T

from loglathe.llm import whitening

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("x", T.StringType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("id", T.StringType()),
    ]
)


def _check(spark, rows, components=4):
    got = whitening.whiten(spark.createDataFrame([(i, v, "x", 1, "id") for i, v in rows], SCHEMA), "vec_id", "embedding",
                           components=components).collect()
    usable = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    whole = [(i, tuple(int(np.floor(256 * c)) for c in v)) for i, v in usable]
    want = []
    for dim in {len(v) for _, v in whole}:
        fit = sorted({v for _, v in whole if len(v) == dim})
        n, sums = len(fit), [sum(v[k] for v in fit) for k in range(dim)]
        d = [[n * c - s for c, s in zip(v, sums)] for v in fit]
        exact = np.array([[sum(r[i] * r[j] for r in d) / n**3 for j in range(dim)] for i in range(dim)])
        values, vectors = np.linalg.eigh(exact)
        values, vectors = values[::-1], vectors[:, ::-1]
        for i, v in whole:
            if len(v) != dim:
                continue
            own = [n * c - s for c, s in zip(v, sums)]
            deviation = sum(c * c for c in own)
            for k in range(min(components, dim)):
                wide = np.trace(exact) > 0 and values[k] > 1e-12 * np.trace(exact)
                w = float(np.array([c / n for c in own]) @ vectors[:, k] / np.sqrt(values[k])) if wide else None
                want.append((i, dim, k + 1, n, deviation, w, values[k] / np.trace(exact) if np.trace(exact) > 0 else None))
    key = lambda r: (r[0] is None, r[0] or 0, r[3], r[2], r[4])
    mine = sorted(((r["id"], None, r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"]) for r in got), key=key)
    want = sorted(want, key=key)
    assert [(r[0], *r[2:5]) for r in mine] == [(r[0], *r[2:5]) for r in want]
    signs = {}
    for a, b in zip(mine, want):
        assert (a[5] is None) == (b[5] is None)
        if a[6] is not None:
            assert a[6] == pytest.approx(b[6], rel=1e-6, abs=1e-9)
        if a[5] is not None and abs(b[5]) > 1e-6:
            sign = signs.setdefault((b[1], b[2]), np.sign(a[5] * b[5]))
            assert a[5] * sign == pytest.approx(b[5], rel=1e-6, abs=1e-7)
    errors = [r["identity_error"] for r in got if r["identity_error"] is not None]
    assert all(e < 1e-9 for e in errors)
    return got


def test_against_numpy(spark):
    rng = np.random.default_rng(2)
    shape = rng.normal(size=(6, 6)) * np.array([5, 3, 2, 1, 0.5, 0.2])[:, None]
    rows = [(i, (rng.normal(size=6) @ shape).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # a third of all rows are copies
    _check(spark, rows)


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=3) * np.array([1e13, 1e12, 1e11])).tolist()) for i in range(50)]
    _check(spark, rows)


def test_odd_rows(spark):
    odd = [(1, [1.5, 2.0]), (1, [1.5, 2.0]), (None, [-3.25, 0.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [float("nan"), 1.0]),
           (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (8, [0.0, -0.0]), (9, [0.001, 0.002])]
    got = _check(spark, odd)
    assert {r["id"] for r in got} == {1, None, 7, 8, 9}
    assert all(r["whitened"] is None and r["explained"] is None for r in got if r["id"] == 7)
    beyond = whitening.whiten(spark.createDataFrame([(1, [1e300], "x", 1, "")], SCHEMA), "vec_id", "embedding")
    assert beyond.collect() == []
    assert whitening.whiten(spark.createDataFrame([], SCHEMA), "vec_id", "embedding").collect() == []


def test_sums_of_squares_are_exact():
    rng = np.random.default_rng(1)
    for top in (10, 1 << 51):
        d = rng.integers(-top, top, size=(whitening.ROWS, 3))
        assert list(whitening._squares(d)) == [sum(int(x) ** 2 for x in d[:, k]) for k in range(3)]
    for total in (0, 5, -5, 1 << 60, -(1 << 60), 3**100, -(3**100)):
        assert sum(p << (60 * k) for k, p in enumerate(whitening._parts(total))) == total
    assert all(-(1 << 63) < p < 1 << 63 for p in whitening._parts(-(3**100)))
    assert len(list(combinations_with_replacement(range(3), 2))) == 6
