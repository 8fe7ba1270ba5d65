"""Neighbourhood operators on grids.

Two forms. Sums over boxes are separable, so they are two passes of range
windows, by row and by column. Everything else runs on blocks: each cell is
sent to every tile whose halo holds it, and a numpy kernel sees one padded
tile. Both are exact at tile borders; rules for the grid's own border differ
by operator and are stated there.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE = 256


def odd_window(metres: float, res: float) -> int:
    """Odd number of cells, three at least; halves round to even first."""
    n = round(metres / res)
    return max(3, n + 1 if n % 2 == 0 else n)


def box_mean(cells: DataFrame, band: str, size: int, out: str) -> DataFrame:
    """Mean over a box of ``size`` cells that ignores nulls and shrinks at the border.

    Sums and counts of values are separable, so each is a range window along
    rows and one along columns; missing cells count as null.
    """
    h = size // 2
    across = Window.partitionBy("row").orderBy("col").rangeBetween(-h, h)
    down = Window.partitionBy("col").orderBy("row").rangeBetween(-h, h)
    one = cells.withColumn("__s", F.sum(band).over(across)).withColumn("__n", F.count(band).over(across))
    two = one.withColumn("__s", F.sum("__s").over(down)).withColumn("__n", F.sum("__n").over(down))
    return two.withColumn(out, F.when(F.col("__n") > 0, F.col("__s") / F.col("__n"))).drop("__s", "__n")


def local_relief(cells: DataFrame, res: float, windows_m: tuple[float, ...] = (5, 15), band: str = "z") -> DataFrame:
    """Height above the local mean, one band ``slrm_<window>`` each."""
    for m in windows_m:
        cells = box_mean(cells, band, odd_window(m, res), "__mean").withColumn(f"slrm_{m:g}", F.col(band) - F.col("__mean")).drop("__mean")
    return cells


def roughness(cells: DataFrame, res: float, window_m: float = 5, band: str = "z", out: str = "rugosite") -> DataFrame:
    """Root of the box mean of squared residuals from the box mean."""
    n = odd_window(window_m, res)
    r = box_mean(cells, band, n, "__mean").withColumn("__r2", (F.col(band) - F.col("__mean")) * (F.col(band) - F.col("__mean")))
    return box_mean(r, "__r2", n, "__m2").withColumn(out, F.sqrt("__m2")).drop("__mean", "__r2", "__m2")


def slope(cells: DataFrame, res: float, band: str = "z", out: str = "pente", unit: str = "degrees") -> DataFrame:
    """Slope by the eight-neighbour weighted gradient; null where a neighbour is missing.

    The gradient is separable: differences and weighted sums along rows, then along columns.
    """
    across, down = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    left = F.when(F.lag("col").over(across) == F.col("col") - 1, F.lag(band).over(across))
    right = F.when(F.lead("col").over(across) == F.col("col") + 1, F.lead(band).over(across))
    rows = cells.withColumn("__d", right - left).withColumn("__w", left + 2 * F.col(band) + right)
    above = lambda c: F.when(F.lag("row").over(down) == F.col("row") - 1, F.lag(c).over(down))
    below = lambda c: F.when(F.lead("row").over(down) == F.col("row") + 1, F.lead(c).over(down))
    gx = (above("__d") + 2 * F.col("__d") + below("__d")) / (8 * res)
    gy = (above("__w") - below("__w")) / (8 * res)
    both = rows.withColumn("__x", gx).withColumn("__y", gy)
    tan = F.sqrt(F.col("__x") * F.col("__x") + F.col("__y") * F.col("__y"))
    value = {"degrees": F.degrees(F.atan(tan)), "radians": F.atan(tan), "tangent": tan}[unit]
    return both.withColumn(out, F.when(F.col(band).isNotNull(), value)).drop("__d", "__w", "__x", "__y")


def on_tiles(cells: DataFrame, grid: dict, halo: int, kernel: Callable[[dict[str, np.ndarray], dict], dict[str, np.ndarray]], bands: list[str],
             outputs: list[str], tile: int = TILE) -> DataFrame:
    """Run a numpy kernel over tiles with a halo and return its bands for each cell.

    ``kernel`` gets arrays of a padded tile (NaN where there is no value) and
    ``{"top", "left", "bottom", "right"}``: how many halo cells the grid
    really has on each side. A cell is sent to its own tile and to those
    whose halo it lies in, so a tile is one bounded group.
    """
    nrow, ncol = grid["nrow"], grid["ncol"]
    reach = lambda v, n: F.sequence(F.greatest(F.floor((v - halo) / tile), F.lit(0)).cast("int"), F.least(F.floor((v + halo) / tile), F.lit((n - 1) // tile)).cast("int"))
    sent = cells.select("row", "col", *bands).withColumn("tr", F.explode(reach(F.col("row"), nrow))).withColumn("tc", F.explode(reach(F.col("col"), ncol)))
    schema = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType())] + [T.StructField(o, T.DoubleType()) for o in outputs])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(key[0]), int(key[1])
        r0, c0 = tr * tile, tc * tile
        r1, c1 = min(r0 + tile, nrow), min(c0 + tile, ncol)
        a0, b0, a1, b1 = max(r0 - halo, 0), max(c0 - halo, 0), min(r1 + halo, nrow), min(c1 + halo, ncol)
        rows, cols = pdf["row"].to_numpy() - a0, pdf["col"].to_numpy() - b0
        arrays, given = {}, np.zeros((a1 - a0, b1 - b0), bool)
        given[rows, cols] = True
        for b in bands:
            a = np.full((a1 - a0, b1 - b0), np.nan)
            a[rows, cols] = pdf[b].to_numpy(dtype=float)
            arrays[b] = a
        got = kernel(arrays, {"top": r0 - a0, "left": c0 - b0, "bottom": a1 - r1, "right": b1 - c1})
        inner = (slice(r0 - a0, r1 - a0), slice(c0 - b0, c1 - b0))
        rr, cc = np.nonzero(given[inner])
        out = pd.DataFrame({"row": (rr + r0).astype(np.int32), "col": (cc + c0).astype(np.int32)})
        for o in outputs:
            out[o] = got[o][inner][rr, cc]
        return out

    done = sent.groupBy("tr", "tc").applyInPandas(run, schema)
    return done.select("row", "col", *[F.when(~F.isnan(o), F.col(o)).alias(o) for o in outputs])


# ---- ridges and valleys


def gaussian(sigma_px: float) -> np.ndarray:
    r = math.ceil(3 * sigma_px)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma_px) ** 2)
    return k / k.sum()


def hessian(z: np.ndarray, sigma_m: float, res: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scale-normalised second derivatives of the smoothed surface; the cross term counts y upward. NaN near gaps and borders."""
    k = gaussian(sigma_m / res)
    r = len(k) // 2
    p = np.pad(z, r + 1, constant_values=np.nan)
    tmp = sum(w * p[:, i : p.shape[1] - 2 * r + i] for i, w in enumerate(k))
    s = sum(w * tmp[i : tmp.shape[0] - 2 * r + i] for i, w in enumerate(k))
    mid = s[1:-1, 1:-1]
    hxx = (s[1:-1, 2:] - 2 * mid + s[1:-1, :-2]) / res**2
    hyy = (s[2:, 1:-1] - 2 * mid + s[:-2, 1:-1]) / res**2
    hxy = (s[:-2, 2:] - s[:-2, :-2] - s[2:, 2:] + s[2:, :-2]) / (4 * res**2)
    return tuple(h * sigma_m**2 for h in (hxx, hyy, hxy))


def frangi(hxx, hyy, hxy, c: float, beta: float = 0.5):
    """Valley-likeness and direction (degrees): eigenvalues by size, no answer to ridges."""
    mean, d = (hxx + hyy) / 2, np.sqrt(((hxx - hyy) / 2) ** 2 + hxy**2)
    a, b = mean - d, mean + d
    swap = np.abs(a) > np.abs(b)
    l1, l2 = np.where(swap, b, a), np.where(swap, a, b)
    s = np.sqrt(l1**2 + l2**2)
    with np.errstate(all="ignore"):
        v = np.exp(-((l1 / l2) ** 2) / (2 * beta**2)) * (1 - np.exp(-(s**2) / (2 * c**2)))
    v = np.where(np.isnan(l2) | (l2 <= 0), 0.0, v)
    return v, np.mod(np.degrees(np.arctan2(l1 - hxx, hxy)), 180.0), s


def vessel_scale(cells: DataFrame, grid: dict, scales_m: tuple[float, ...] = (1, 2, 4), band: str = "z", tile: int = TILE) -> list[float]:
    """Half the greatest strength at each scale: what anchors vesselness independent of the extent. A few numbers come to the driver."""
    res = grid["res"]
    halo = max(math.ceil(3 * s / res) for s in scales_m) + 1

    def kernel(a, edges):
        out = {}
        for k, s in enumerate(scales_m):
            out[f"s{k}"] = frangi(*hessian(a[band], s, res), 1.0)[2]
        return out

    names = [f"s{k}" for k in range(len(scales_m))]
    row = on_tiles(cells, grid, halo, kernel, [band], names, tile).agg(*[F.max(n).alias(n) for n in names]).first()
    return [0.5 * row[n] if row[n] else 1.0 for n in names]


def check_scale(c, scales: int) -> list[float]:
    """One positive number for all scales or one for each."""
    values = [float(x) for x in (c if isinstance(c, (list, tuple)) else [c] * scales)]
    if len(values) != scales or not all(math.isfinite(v) and v > 0 for v in values):
        raise ValueError("c: one finite positive number, or one for each scale")
    return values


def vesselness(cells: DataFrame, grid: dict, scales_m: tuple[float, ...] = (1, 2, 4), beta: float = 0.5, c=None, band: str = "z", tile: int = TILE) -> DataFrame:
    """``(row, col, vesselness, theta)``: best over scales, the first of equals; direction of the winning scale."""
    res = grid["res"]
    anchors = check_scale(c if c is not None else vessel_scale(cells, grid, scales_m, band, tile), len(scales_m))
    halo = max(math.ceil(3 * s / res) for s in scales_m) + 1

    def kernel(a, edges):
        best, angle = None, None
        for s, ck in zip(scales_m, anchors):
            v, t, _ = frangi(*hessian(a[band], s, res), ck, beta)
            if best is None:
                best, angle = v, t
            else:
                win = v > best
                best, angle = np.where(win, v, best), np.where(win, t, angle)
        return {"vesselness": best, "theta": angle}

    return on_tiles(cells, grid, halo, kernel, [band], ["vesselness", "theta"], tile)


# ---- sky view and openness


def horizon_shifts(directions: int, radius: int, scale: int = 3) -> list[list[tuple[int, int, float]]]:
    """For each direction the distinct cell shifts out to the radius, with their distances, nearest first."""
    out = []
    for d in range(directions):
        angle = 2 * math.pi * d / directions
        seen = {}
        for k in range(1, radius * scale + 1):
            reach = k / scale
            shift = (round(reach * math.cos(angle)), round(reach * math.sin(angle)))
            if shift != (0, 0):
                seen[shift] = math.hypot(*shift)
        out.append(sorted(((r, c, dist) for (r, c), dist in seen.items()), key=lambda x: x[2]))
    return out


def reflect_pad(z: np.ndarray, halo: int, edges: dict[str, int]) -> np.ndarray:
    """Fill the part of the halo that lies beyond the grid by reflection about the border cell."""
    need = [(halo - edges["top"], halo - edges["bottom"]), (halo - edges["left"], halo - edges["right"])]
    out = z
    for axis, (a, b) in enumerate(need):
        n = out.shape[axis]
        idx = np.arange(-a, n + b)
        if n > 1:
            period = 2 * (n - 1)
            idx = np.mod(idx, period)
            idx = np.where(idx >= n, period - idx, idx)
        else:
            idx = np.zeros_like(idx)
        out = np.take(out, idx, axis=axis)
    return out


def sky(z: np.ndarray, halo: int, directions: int, radius: int, res: float) -> tuple[np.ndarray, np.ndarray]:
    """Sky-view factor and openness (degrees) of the inner part of a padded array."""
    h = z / res
    n, m = h.shape[0] - 2 * halo, h.shape[1] - 2 * halo
    centre = h[halo : halo + n, halo : halo + m]
    svf, opn = np.zeros((n, m)), np.zeros((n, m))
    for shifts in horizon_shifts(directions, radius):
        top = np.full((n, m), -1000.0)
        for r, c, dist in shifts:
            top = np.fmax(top, (h[halo + r : halo + r + n, halo + c : halo + c + m] - centre) / dist)
        ang = np.arctan(top)
        svf += 1 - np.sin(np.maximum(ang, 0))
        opn += ang
    svf, opn = svf / directions, np.degrees(np.pi / 2 - opn / directions)
    gap = np.isnan(centre)
    return np.where(gap, np.nan, svf), np.where(gap, np.nan, opn)


def micro_relief(cells: DataFrame, grid: dict, radius_m: float = 10, directions: int = 16, band: str = "z", tile: int = TILE) -> DataFrame:
    """``(row, col, svf, openness_pos, openness_neg)``; the grid's border reflects, gaps stay gaps."""
    res = grid["res"]
    radius = max(1, round(radius_m / res))

    def kernel(a, edges):
        z = reflect_pad(a[band], radius, edges)
        svf, pos = sky(z, radius, directions, radius, res)
        _, neg = sky(-z, radius, directions, radius, res)
        pad = lambda x: np.pad(x, ((edges["top"], edges["bottom"]), (edges["left"], edges["right"])), constant_values=np.nan)
        return {"svf": pad(svf), "openness_pos": pad(pos), "openness_neg": pad(neg)}

    return on_tiles(cells, grid, radius, kernel, [band], ["svf", "openness_pos", "openness_neg"], tile)


def terrain_layers(cells: DataFrame, grid: dict, openness_m: tuple[float, ...] = (2, 5, 10), relief_m: tuple[float, ...] = (5, 15), roughness_m: float = 5,
                   scales_m: tuple[float, ...] = (1, 2, 4), c=None, tile: int = TILE) -> DataFrame:
    """All terrain channels: slope, roughness, local relief, openness at each radius, sky view at the largest, vesselness and theta."""
    res = grid["res"]
    done = roughness(local_relief(slope(cells, res), res, relief_m), res, roughness_m)
    for m in openness_m:
        got = micro_relief(cells, grid, m, tile=tile)
        keep = [F.col("openness_neg").alias(f"openness_neg_{m:g}")]
        if m == max(openness_m):
            keep += ["svf", "openness_pos"]
        done = done.join(got.select("row", "col", *keep), ["row", "col"], "left")
    return done.join(vesselness(cells, grid, scales_m, c=c, tile=tile), ["row", "col"], "left")


def thin(mask: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Skeleton of a mask by alternating deletions of border cells that carry no connection; outside counts as empty."""
    m = np.pad(mask.astype(bool), 1)
    for _ in range(rounds):
        changed = False
        for first in (True, False):
            n = [m[:-2, 1:-1], m[:-2, 2:], m[1:-1, 2:], m[2:, 2:], m[2:, 1:-1], m[2:, :-2], m[1:-1, :-2], m[:-2, :-2]]
            total = sum(x.astype(int) for x in n)
            turns = sum((~n[k] & n[(k + 1) % 8]).astype(int) for k in range(8))
            north, east, south, west = n[0], n[2], n[4], n[6]
            corner = ~(north & east & south) & ~(east & south & west) if first else ~(north & east & west) & ~(north & south & west)
            drop = m[1:-1, 1:-1] & (total >= 2) & (total <= 6) & (turns == 1) & corner
            if drop.any():
                m[1:-1, 1:-1] &= ~drop
                changed = True
        if not changed:
            break
    return m[1:-1, 1:-1]
