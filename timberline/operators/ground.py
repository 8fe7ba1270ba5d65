"""Heights over a triangulated ground: Delaunay triangles by tile, found point by point.

The triangle over a spot is the facet of the lower hull of the lifted ground
points (x, y, x^2 + y^2) above it. It is sought for all spots of a square at once by pivots: the
point that lies deepest below a spot's facet enters, and that corner leaves without which the facet
still covers the spot. A facet is final when its circle lies inside what was looked at; else
the window around the square grows, up to a tile with its halo. Spots that even this leaves open
go on to tiles four times as wide. So the triangles are those of the whole table,
whatever the tiles, except where circles reach beyond the widest halo: along the outer hull and around large gaps.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.session import materialize, release

#: Spots of a tile that one group looks up, about.
SPOTS = 50_000
#: Ground points of a square, about, and how far lifted points are moved by a hash, in square units: points on a common circle get an order that tiles agree on.
SQUARE, LIFT = 16, 1e-6
#: Space that a circle must leave to the edge of what was looked at: more than the lift of points moves it.
EDGE = 1e-4
_FAR, _HIGH = 16.0, 1e6


def _scatter(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for each place."""
    h = np.zeros(len(x), np.uint64)
    for v in (x, y):
        h = (h ^ v.astype(np.float64).view(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(11)).astype(float) / (1 << 53)


def facets(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For each spot the three ground points of the Delaunay triangle over it; -1 where the hull of ``p`` does not cover it."""
    low, high = p.min(axis=0), p.max(axis=0)
    centre, size = (low + high) / 2, max(float((high - low).max()), float(abs(q - (low + high) / 2).max()) * 2, 1e-9)
    lifted = ((p - centre) ** 2).sum(axis=1) / size**2 + LIFT * _scatter(p[:, 0], p[:, 1]) / size**2
    xy = np.concatenate([(p - centre) / size, [[-_FAR, -_FAR], [_FAR, -_FAR], [0.0, 2 * _FAR]]])
    w = np.concatenate([lifted, [_HIGH] * 3])
    # spots are moved by a hair, inward and so that none lies on an edge
    s = (q - centre) / size
    s = s + 1e-9 * ((p.mean(axis=0) - centre) / size - s) + 1e-11 * (np.stack([_scatter(q[:, 0], q[:, 1]), _scatter(q[:, 1], q[:, 0])], axis=1) - 0.5)
    n = len(p)
    found = np.tile(np.array([n, n + 1, n + 2]), (len(q), 1))
    active = np.arange(len(q))
    for _ in range(1000):
        if not len(active):
            break
        t = found[active]
        a, b, c = (xy[t[:, k]] for k in range(3))
        u, v = b - a, c - a
        det = u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
        wu, wv = w[t[:, 1]] - w[t[:, 0]], w[t[:, 2]] - w[t[:, 0]]
        gx, gy = (wu * v[:, 1] - wv * u[:, 1]) / det, (wv * u[:, 0] - wu * v[:, 0]) / det
        rise = gx[:, None] * (xy[:n, 0] - a[:, :1]) + gy[:, None] * (xy[:n, 1] - a[:, 1:]) + w[t[:, 0]][:, None] - w[:n]
        rise[np.arange(len(active))[:, None], np.minimum(t, n - 1)] = np.where(t < n, -np.inf, rise[np.arange(len(active))[:, None], np.minimum(t, n - 1)])
        deepest = rise.argmax(axis=1)
        depth = rise[np.arange(len(active)), deepest]
        go = depth > 1e-14 * (1 + abs(gx) + abs(gy))
        active, t, deepest, a, u, v, det = active[go], t[go], deepest[go], a[go], u[go], v[go], det[go]

        def corners(at):
            d = at - a
            k1, k2 = (d[:, 0] * v[:, 1] - d[:, 1] * v[:, 0]) / det, (u[:, 0] * d[:, 1] - u[:, 1] * d[:, 0]) / det
            return np.stack([1 - k1 - k2, k1, k2], axis=1)

        mine, new = corners(s[active]), corners(xy[deepest])
        ratio = np.where(new > 0, mine / np.where(new > 0, new, 1), np.inf)
        t[np.arange(len(active)), ratio.argmin(axis=1)] = deepest
        found[active] = t
    found[(found >= n).any(axis=1)] = -1
    return found


def _circles(p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and radii of the circles through triangles."""
    a, b, c = (p[t[:, k]] for k in range(3))
    u, v = b - a, c - a
    d = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    uu, vv = (u * u).sum(axis=1), (v * v).sum(axis=1)
    off = np.stack([v[:, 1] * uu - u[:, 1] * vv, u[:, 0] * vv - v[:, 0] * uu], axis=1) / np.where(d == 0, np.nan, d)[:, None]
    return a + off, np.hypot(off[:, 0], off[:, 1])


def _plane(q: np.ndarray, p: np.ndarray, z: np.ndarray, t: np.ndarray) -> np.ndarray:
    a, b, c = (p[t[:, k]] for k in range(3))
    u, v, d = b - a, c - a, q - a
    det = u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
    k1, k2 = (d[:, 0] * v[:, 1] - d[:, 1] * v[:, 0]) / det, (u[:, 0] * d[:, 1] - u[:, 1] * d[:, 0]) / det
    return z[t[:, 0]] * (1 - k1 - k2) + z[t[:, 1]] * k1 + z[t[:, 2]] * k2


def heights(q: np.ndarray, p: np.ndarray, z: np.ndarray, box: tuple[float, float, float, float] | None) -> tuple[np.ndarray, np.ndarray]:
    """Ground under each spot and whether that is certain, given all ground points in ``box`` (None: all there are).

    What is not certain has the triangle among the given points, the nearest point where none covers the spot, NaN without points.
    """
    out, sure = np.full(len(q), np.nan), np.zeros(len(q), bool)
    if not len(p) or not len(q):
        return out, sure
    low, high = np.minimum(p.min(axis=0), q.min(axis=0)), np.maximum(p.max(axis=0), q.max(axis=0))
    side = max(float(np.sqrt(np.prod(np.maximum(high - low, 1e-9)) * SQUARE / len(p))), float((high - low).max()) / 512, 1e-9)
    at = lambda v: np.floor((v - low) / side).astype(np.int64)
    wide = at(high)[1] + 1
    place = at(p)
    order = np.argsort(place[:, 0] * wide + place[:, 1], kind="stable")
    keys = (place[:, 0] * wide + place[:, 1])[order]
    spots = at(q)
    todo, reach = np.arange(len(q)), 2
    while len(todo):
        last = reach >= max(at(high)) + 1
        code = spots[todo, 0] * wide + spots[todo, 1] if not last else np.zeros(len(todo), np.int64)
        turn = np.argsort(code, kind="stable")
        left = []
        for mine in np.split(todo[turn], np.flatnonzero(np.diff(code[turn])) + 1):
            i, j = spots[mine[0]]
            if last:
                near = np.arange(len(p))
            else:
                rows = np.arange(max(i - reach, 0), i + reach + 1)
                j0, j1 = max(j - reach, 0), min(j + reach, wide - 1)
                spans = zip(np.searchsorted(keys, rows * wide + j0), np.searchsorted(keys, rows * wide + j1, "right"))
                near = np.concatenate([order[x:y] for x, y in spans])
            if len(near) < 3:
                if last:
                    far = ((q[mine][:, None] - p[near]) ** 2).sum(axis=2)
                    out[mine] = z[near][far.argmin(axis=1)]
                else:
                    left.append(mine)
                continue
            for k in range(0, len(mine), max(64, 4_000_000 // len(near))):
                some = mine[k : k + max(64, 4_000_000 // len(near))]
                t = facets(q[some], p[near])
                ok = t[:, 0] >= 0
                centre, radius = _circles(p[near], np.where(ok[:, None], t, 0))
                known = np.array([[-np.inf, -np.inf], [np.inf, np.inf]])
                if not last:
                    known = np.array([[low + (np.array([i, j]) - reach) * side], [low + (np.array([i, j]) + reach + 1) * side]]).reshape(2, 2)
                if box is not None:
                    known = np.array([np.maximum(known[0], box[:2]), np.minimum(known[1], box[2:])])
                room = radius[:, None] + EDGE  # points on the edge may lie in the next square
                inside = ok & (centre - room > known[0]).all(axis=1) & (centre + room < known[1]).all(axis=1)
                done = inside | (ok if last else False)
                out[some[done]] = _plane(q[some[done]], p[near], z[near], t[done])
                sure[some[inside]] = True
                if last:
                    bare = some[~ok]
                    for b in range(0, len(bare), 1024):
                        far = ((q[bare[b : b + 1024]][:, None] - p[near]) ** 2).sum(axis=2)
                        out[bare[b : b + 1024]] = z[near][far.argmin(axis=1)]
                else:
                    left.append(some[~inside])
        if last:
            break
        todo = np.concatenate(left) if left else np.empty(0, np.int64)
        reach = reach * 2 + 1
    return out, sure


def _look(side: float, reach: float):
    """Heights of a tile's spots; the ground comes with a halo."""

    def look(key, mine, near):
        x0, y0 = float(key[0]) * side, float(key[1]) * side
        near = near.sort_values(["x", "y"])
        box = (x0 - reach, y0 - reach, x0 + side + reach, y0 + side + reach)
        got, sure = heights(mine[["x", "y"]].to_numpy(float), near[["x", "y"]].to_numpy(float), near["z"].to_numpy(float), box)
        return pd.DataFrame({"x": mine["x"], "y": mine["y"], "ground": got, "sure": sure})

    return look


def ground_heights(spots: DataFrame, ground: DataFrame, tile: float = 64.0, halo: float = 32.0, rounds: int = 3) -> DataFrame:
    """``(x, y, ground)`` for each distinct spot ``(x, y)`` from triangulated ground points ``(x, y, z)``.

    Of ground points at one place the lowest counts. Each round has tiles and halos four times as wide, for the spots that the one
    before left open; after the last, what is still open takes the triangle or the nearest point within that halo, null without any.
    Tiles with many spots are dealt over several groups.
    """
    points = ground.filter("x is not null and y is not null and z is not null").groupBy("x", "y").agg(F.min(F.col("z").cast("double")).alias("z"))
    points = materialize(points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "z"))
    open_ = materialize(spots.filter("x is not null and y is not null").select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct())
    done, used = None, [points]
    for k in range(rounds):
        side, reach, last = tile * 4**k, halo * 4**k, k == rounds - 1

        placed = open_.select("x", "y", F.floor(F.col("x") / side).alias("tx"), F.floor(F.col("y") / side).alias("ty"))
        asked = materialize(placed.groupBy("tx", "ty").agg(F.ceil(F.count("*") / SPOTS).alias("deals")))
        left = placed.join(asked, ["tx", "ty"]).select("tx", "ty", F.pmod(F.xxhash64("x", "y"), F.col("deals")).alias("deal"), "x", "y")
        asked_too = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # columns of its own: both sides of a cogroup come from it
        span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side)))
        right = points.withColumn("tx", span("x")).withColumn("ty", span("y")).join(asked_too, ["tx", "ty"])
        right = right.select("tx", "ty", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"), "x", "y", "z")
        found = left.groupBy("tx", "ty", "deal").cogroup(right.groupBy("tx", "ty", "deal")).applyInPandas(_look(side, reach), "x double, y double, ground double, sure boolean")
        got = materialize(found)
        used += [open_, asked]
        sure = got.select("x", "y", F.when(~F.isnan("ground"), F.col("ground")).alias("ground")) if last else got.filter("sure").select("x", "y", "ground")
        done = sure if done is None else done.union(sure)
        if last:
            break
        open_ = materialize(got.filter("not sure").select("x", "y"))
        if open_.isEmpty():
            used.append(open_)
            break
    for table in used:
        release(table)
    return done


def normalised(points: DataFrame, ground: DataFrame, **options) -> DataFrame:
    """Points ``(x, y, z, ...)`` with ``h``, their height above the triangulated ground points ``(x, y, z)``; null without ground."""
    under = ground_heights(points.select("x", "y"), ground, **options)
    at = under.select(F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("ground").alias("__ground"))
    joined = points.join(at, (F.col("x").cast("double") == F.col("__x")) & (F.col("y").cast("double") == F.col("__y")), "left")
    return joined.withColumn("h", F.col("z") - F.col("__ground")).drop("__x", "__y", "__ground")
