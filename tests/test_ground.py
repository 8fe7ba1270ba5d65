"""Triangulated ground against all triples of points, and over tiles of any size."""

import itertools

import numpy as np
import pytest

from timberline.operators import ground


def by_triples(q, p, z):
    """Heights over the triangles whose circles hold no other point."""
    out = np.full(len(q), np.nan)
    for i, j, k in itertools.combinations(range(len(p)), 3):
        t = np.array([[i, j, k]])
        u, v = p[j] - p[i], p[k] - p[i]
        if abs(u[0] * v[1] - u[1] * v[0]) < 1e-12:
            continue
        centre, radius = ground._circles(p, t)
        if (np.hypot(*(p - centre[0]).T) < radius[0] - 1e-9).any():
            continue
        det = u[0] * v[1] - u[1] * v[0]
        d = q - p[i]
        k1, k2 = (d[:, 0] * v[1] - d[:, 1] * v[0]) / det, (u[0] * d[:, 1] - u[1] * d[:, 0]) / det
        inside = (k1 >= 0) & (k2 >= 0) & (k1 + k2 <= 1)
        out[inside] = ground._plane(q[inside], p, z, np.repeat(t, inside.sum(), axis=0))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_triangles_have_empty_circles(seed):
    rng = np.random.default_rng(seed)
    p, q = rng.random((32, 2)) * [40, 25] + 1000, rng.random((200, 2)) * [44, 29] + 998
    z = rng.random(32) * 9
    want = by_triples(q, p, z)
    t = ground.facets(q, p)
    covered = ~np.isnan(want)
    assert ((t[:, 0] >= 0) == covered).all() and covered.sum() > 80
    assert np.allclose(ground._plane(q[covered], p, z, t[covered]), want[covered])
    got, sure = ground.heights(q, p, z, None)
    assert np.allclose(got[covered], want[covered]) and (sure == covered).all() and not np.isnan(got).any()
    far = ((q[~covered][:, None] - p) ** 2).sum(axis=2)
    assert np.allclose(got[~covered], z[far.argmin(axis=1)])


def test_points_on_common_circles_and_on_edges():
    """A lattice: every square may be cut either way, and spots lie on corners and edges."""
    x, y = (v.ravel().astype(float) for v in np.mgrid[:14, :11])
    p, z = np.stack([x, y], axis=1), 2 * x - 3 * y + 5
    q = np.concatenate([p, p[:-12] + [0.5, 0.0], p[:-12] + 0.5])
    q = q[(q[:, 0] <= 13) & (q[:, 1] <= 10)]
    got, _ = ground.heights(q, p, z, None)
    assert np.allclose(got, 2 * q[:, 0] - 3 * q[:, 1] + 5)
    z = np.random.default_rng(1).random(len(p))
    whole, _ = ground.heights(q, p, z, None)
    near = (p[:, 0] < 9) & (p[:, 1] < 9)
    part, sure = ground.heights(q, p[near], z[near], (-1.0, -1.0, 8.5, 8.5))
    assert sure.sum() > 60 and np.allclose(part[sure], whole[sure])


@pytest.mark.parametrize("tile", [7.0, 25.0, 500.0])
def test_heights_do_not_depend_on_tiles(spark, tile, monkeypatch):
    monkeypatch.setattr(ground, "SPOTS", 60)
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.random((900, 2)) * 60, rng.random((60, 2)) * [60, 40] + [0, 60]])
    p, z = np.round(p, 2), np.round(rng.random(960) * 20, 2)
    q = np.round(rng.random((400, 2)) * [56, 90] + 2, 2)
    want, _ = ground.heights(q, p, z, None)
    covered = ground.facets(q, p)[:, 0] >= 0
    inner = covered & (q[:, 0] > 8) & (q[:, 0] < 52) & (q[:, 1] > 8) & (q[:, 1] < 85)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in q] + [(None, 1.0), (float(q[0, 0]), float(q[0, 1]))], "x double, y double")
    base = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(p, z)] + [(float(p[0, 0]), float(p[0, 1]), 99.0), (1.0, None, 1.0)], "x double, y double, z double")
    got = {(r.x, r.y): r.ground for r in ground.ground_heights(df, base, tile=tile, halo=tile / 2).collect()}
    assert len(got) == len({tuple(v) for v in q})
    assert inner.sum() > 250
    for k in np.flatnonzero(inner):
        assert abs(got[tuple(q[k])] - want[k]) < 1e-7


def test_points_above_ground_and_without_ground(spark):
    points = spark.createDataFrame([(0.25, 0.25, 7.0, 1), (0.25, 0.25, 9.0, 5), (50.0, 50.0, 3.0, 1), (None, 1.0, 1.0, 1)], "x double, y double, z double, cls int")
    base = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 0.0, 1.0), (0.0, 1.0, 3.0)], "x double, y double, z double")
    got = {(r.x, r.z): r.h for r in ground.normalised(points, base).collect()}
    assert got == {(0.25, 7.0): 5.5, (0.25, 9.0): 7.5, (50.0, 3.0): got[50.0, 3.0], (None, 1.0): None} and got[50.0, 3.0] is not None
    assert {r.h for r in ground.normalised(points, base.limit(0)).collect()} == {None}
    assert ground.normalised(points.limit(0), base).count() == 0
