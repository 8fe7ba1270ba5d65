"""Smoothing and joining of polylines: small numpy helpers and their use over a table of lines (``id, geom``)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

GEOM = "geom array<struct<x:double,y:double>>"


def as_array(geom) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in geom], float).reshape(-1, 2)


def as_geom(xy: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in xy]


def length(xy: np.ndarray) -> float:
    return float(np.hypot(*np.diff(xy, axis=0).T).sum()) if len(xy) > 1 else 0.0


def sinuosity(xy: np.ndarray) -> float:
    """Length over chord; infinite without a chord."""
    chord = math.dist(xy[0], xy[-1]) if len(xy) > 1 else 0.0
    return length(xy) / chord if chord > 0 else math.inf


def savitzky_golay(xy: np.ndarray, window: int, order: int = 2) -> np.ndarray:
    """Each coordinate fitted by a polynomial over a centred window; near the ends the outermost fit is evaluated, the ends themselves stay.

    Lines with fewer points than the window come back as they are.
    """
    w = window if window % 2 else window + 1
    n, h = len(xy), w // 2
    if n < w or w <= order:
        return xy
    t = np.arange(-h, h + 1)
    fit = np.linalg.pinv(np.vander(t, order + 1, increasing=True))  # coefficients from values
    out = np.empty_like(xy)
    for k in range(2):
        out[h : n - h, k] = np.convolve(xy[:, k], fit[0][::-1], "valid")
        for first, rows in ((0, range(h)), (n - w, range(n - h, n))):
            coef = fit @ xy[first : first + w, k]
            for r in rows:
                out[r, k] = np.polyval(coef[::-1], r - first - h)
    out[0], out[-1] = xy[0], xy[-1]
    return out


def bezier_point(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    t = np.asarray(t)[:, None]
    return (1 - t) ** 3 * c[0] + 3 * (1 - t) ** 2 * t * c[1] + 3 * (1 - t) * t**2 * c[2] + t**3 * c[3]


def fit_cubic(xy: np.ndarray, a: np.ndarray, b: np.ndarray, tol: float, depth: int = 8) -> list[np.ndarray]:
    """Cubic pieces through the points within ``tol``, with end tangents ``a`` and ``b``; splits at the worst point."""
    first, last = xy[0], xy[-1]
    if len(xy) == 2:
        d = math.dist(first, last) / 3
        return [np.array([first, first + a * d, last + b * d, last])]
    step = np.hypot(*np.diff(xy, axis=0).T)
    u = np.concatenate([[0.0], np.cumsum(step)]) / max(step.sum(), 1e-12)
    b0, b1, b2, b3 = (1 - u) ** 3, 3 * u * (1 - u) ** 2, 3 * u**2 * (1 - u), u**3
    ca, cb = b1[:, None] * a, b2[:, None] * b
    rest = xy - (b0 + b1)[:, None] * first - (b2 + b3)[:, None] * last
    m = np.array([[(ca * ca).sum(), (ca * cb).sum()], [(ca * cb).sum(), (cb * cb).sum()]])
    v = np.array([(ca * rest).sum(), (cb * rest).sum()])
    third = math.dist(first, last) / 3
    alpha = np.linalg.solve(m, v) if abs(np.linalg.det(m)) > 1e-12 else np.array([third, third])
    if alpha.min() < 1e-6:
        alpha = np.array([third, third])
    curve = np.array([first, first + a * alpha[0], last + b * alpha[1], last])
    gap = np.hypot(*(bezier_point(curve, u) - xy).T)
    if gap.max() <= tol or depth == 0:
        return [curve]
    k = int(np.clip(gap.argmax(), 1, len(xy) - 2))
    mid = unit(xy[k - 1] - xy[k + 1])
    return fit_cubic(xy[: k + 1], a, mid, tol, depth - 1) + fit_cubic(xy[k:], -mid, b, tol, depth - 1)


def unit(v: np.ndarray) -> np.ndarray:
    n = math.hypot(*v)
    return v / n if n > 0 else v


def bezier_smooth(xy: np.ndarray, tol: float, step: float) -> np.ndarray:
    """The line as cubic pieces, sampled every ``step``; the ends stay."""
    keep = np.concatenate([[True], np.hypot(*np.diff(xy, axis=0).T) > 1e-9])
    xy = xy[keep]
    if len(xy) < 3:
        return xy
    out = [xy[:1]]
    for c in fit_cubic(xy, unit(xy[1] - xy[0]), unit(xy[-2] - xy[-1]), tol):
        n = max(2, math.ceil(math.dist(c[0], c[3]) / step))
        out.append(bezier_point(c, np.linspace(0, 1, n + 1)[1:]))
    got = np.concatenate(out)
    got[-1] = xy[-1]
    return got


def simplify(xy: np.ndarray, tol: float) -> np.ndarray:
    """Points that are needed to stay within ``tol`` of the line; an explicit stack, so long lines are fine."""
    keep = np.zeros(len(xy), bool)
    keep[[0, -1]] = True
    stack = [(0, len(xy) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d = xy[b] - xy[a]
        n = float(d @ d)
        rel = xy[a + 1 : b] - xy[a]
        t = np.clip(rel @ d / n, 0, 1) if n > 0 else np.zeros(len(rel))
        gap = np.hypot(*(rel - t[:, None] * d).T)
        if gap.max() > tol:
            k = a + 1 + int(gap.argmax())
            keep[k] = True
            stack += [(a, k), (k, b)]
    return xy[keep]


def smooth_lines(lines: DataFrame, method: str = "savitzky", res: float = 1.0, by: float | None = None, id_col: str = "id") -> DataFrame:
    """Smoothed geometry of each line; ``by`` is the window (7 m) or the tolerance (two cells), in metres."""

    def run(frames):
        for pdf in frames:
            out = []
            for g in pdf["geom"]:
                xy = as_array(g)
                if method == "savitzky":
                    xy = savitzky_golay(xy, max(3, round((by or 7.0) / res)))
                elif method == "bezier":
                    xy = bezier_smooth(xy, by or 2 * res, res)
                out.append(as_geom(xy))
            yield pd.DataFrame({id_col: pdf[id_col], "geom": out})

    return lines.select(id_col, "geom").mapInPandas(run, f"{id_col} long, {GEOM}")


def finalise(lines: DataFrame, tol: float = 1.0, length_min: float = 30.0, id_col: str = "id") -> DataFrame:
    """Simplified lines of ``length_min`` at least: ``id, longueur, geom``; ids stay."""

    def run(frames):
        for pdf in frames:
            got = [simplify(as_array(g), tol) for g in pdf["geom"]]
            out = pd.DataFrame({id_col: pdf[id_col], "longueur": [length(x) for x in got], "geom": [as_geom(x) for x in got]})
            yield out[out.longueur >= length_min]

    return lines.select(id_col, "geom").mapInPandas(run, f"{id_col} long, longueur double, {GEOM}")


def join_ends(lines: list[np.ndarray], reach: float, angle: float = 40.0) -> list[np.ndarray]:
    """Join free ends that are close and point at each other, nearest pairs first. For one component at a time."""
    if reach <= 0:
        return lines
    ends = [(i, e) for i in range(len(lines)) for e in (0, -1)]
    pos = {k: lines[k[0]][k[1]] for k in ends}
    out_dir = {(i, e): unit(lines[i][0] - lines[i][min(3, len(lines[i]) - 1)]) if e == 0 else unit(lines[i][-1] - lines[i][max(-4, -len(lines[i]))]) for i, e in ends}
    pairs = []
    for a in range(len(ends)):
        for b in range(a + 1, len(ends)):
            p, q = ends[a], ends[b]
            d = pos[q] - pos[p]
            dist = math.hypot(*d)
            if p[0] != q[0] and dist <= reach:
                u = unit(d) if dist > 0 else out_dir[p]
                fits = all(math.degrees(math.acos(float(np.clip(x, -1, 1)))) <= angle for x in (out_dir[p] @ u, out_dir[q] @ -u))
                if fits:
                    pairs.append((dist, p, q))
    used, merged = set(), {i: i for i in range(len(lines))}
    chains = {i: lines[i] for i in range(len(lines))}
    for _, p, q in sorted(pairs, key=lambda x: (x[0], x[1], x[2])):
        a, b = merged[p[0]], merged[q[0]]
        if p in used or q in used or a == b:
            continue
        used |= {p, q}
        left, right = chains[a], chains[b]
        left = left if np.allclose(left[-1], pos[p]) else left[::-1]
        right = right if np.allclose(right[0], pos[q]) else right[::-1]
        chains[a] = np.concatenate([left, right])
        del chains[b]
        for k, v in merged.items():
            if v == b:
                merged[k] = a
    return list(chains.values())
