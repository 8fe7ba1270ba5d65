"""Whitening against the eigenvectors of the covariance of all distinct rows at once."""

import math
import random

import numpy as np
import pytest

from timberline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component string, x double"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0, "c", 0.0) for i, v in rows], SCHEMA).repartition(parts)


def some(n=240, d=9, seed=1):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d)) * np.linspace(2, 0.3, d)
    rows = [(k, [float(c) for c in row]) for k, row in enumerate(rng.normal(size=(n, d)) @ mix)]
    return rows + [(n + k, rows[0][1]) for k in range(50)] + [(900, None), (901, [1.0, None] * 4 + [0.0]), (902, [float("nan")] * d), (903, [float("inf")] * d), (904, []), (905, [1.0]), (None, rows[3][1]), (2, rows[4][1])]


def usable(rows, d):
    ok = [(i, v) for i, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in ok]


def check(got, rows, d, count=16):
    kept = usable(rows, d)
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = np.array([[float(v * n - s) / n for v, s in zip(row, sums)] for row in fit])
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    used = min(count, int((e > 1e-10 * e[0]).sum()))
    assert len(got) == len(kept) * used
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    for i, x in kept:
        dev = sum((v * n - s) ** 2 for v, s in zip(x, sums))
        mine = by[i, dev]
        assert sorted(mine) == list(range(1, used + 1)) and all(r.n == n for r in mine.values())
    signs = {}
    for i, x in kept:
        dev = sum((v * n - s) ** 2 for v, s in zip(x, sums))
        want = (np.array([float(v * n - s) / n for v, s in zip(x, sums)]) @ vectors[:, :used]) / np.sqrt(e[:used])
        for k in range(used):
            mine = by[i, dev][k + 1]
            if abs(want[k]) > 1e-3:
                signs.setdefault(k, set()).add(np.sign(mine.whitened) == np.sign(want[k]))
            assert abs(abs(mine.whitened) - abs(want[k])) < 1e-8
            assert abs(mine.explained / (e[k] / e.sum()) - 1) < 1e-9
    assert all(len(s) == 1 for s in signs.values())
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


@pytest.mark.parametrize("d,count", [(9, 16), (20, 16)])
def test_whitened_rows_against_one_decomposition(spark, d, count):
    rows = some(d=d)
    check(whitening.whiten(vectors(spark, rows)).collect(), rows, d, count)


def test_many_levels_and_batches_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 5)
    rows = some(n=300, d=6, seed=3)
    x = whitening.quantized(vectors(spark, rows, parts=11)).select("x").distinct().repartition(13)
    found = whitening.summary(x, fan_in=2)
    whole = np.array([r.x for r in x.collect()])
    s = np.linalg.svd(whole - whole.mean(axis=0), compute_uv=False)
    assert found.n == len(whole) and found.sums == [int(v) for v in whole.sum(axis=0)]
    assert len(found.values) == 6 and np.allclose(found.values, s, rtol=1e-9)
    assert np.allclose((found.vectors.T * found.values**2) @ found.vectors, np.cov(whole.T, bias=True) * len(whole), rtol=1e-9, atol=1e-6)


def test_merging_is_the_decomposition_of_both():
    rng = np.random.default_rng(5)
    a, b = rng.integers(-500, 500, (7, 12)) + 10**6, rng.integers(0, 90, (1, 12)) + 10**6
    both = np.vstack([a, b])
    one = whitening.Summary.of(a).merged(whitening.Summary.of(b))
    two = whitening.Summary.of(both)
    assert one.n == 8 and one.sums == two.sums and len(one.values) == 12
    assert np.allclose(one.values, two.values, atol=1e-8)
    assert np.allclose((one.vectors.T * one.values**2) @ one.vectors, (two.vectors.T * two.values**2) @ two.vectors, atol=1e-6)
    assert whitening.Summary.read(one.row()).sums == one.sums


def test_flat_directions_and_tables_without_variance(spark):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1), 2.0, rng.gauss(0, 3)]) for k in range(60)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2} and len(got) == 120
    assert whitening.whiten(vectors(spark, [(k, [1.0, 2.0]) for k in range(5)])).count() == 0
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).columns == whitening.whiten(vectors(spark, rows)).columns


def test_deviations_beyond_a_long_are_null(spark):
    got = whitening.whiten(vectors(spark, [(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 3.0])])).collect()
    assert {r.deviation for r in got} == {None} and all(math.isfinite(r.whitened) for r in got)
