"""Cross-profiles and what is measured on them.

Stations explode from traces; heights across them are read from the block of the raster that a station lies in. The reading of a
profile is sequential along its offsets, so it runs as a pandas group for
each trace over the arrays of its stations.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators import blocks
from timberline.operators.stations import fitted_radius, long_slope, smooth


#: Cells of a block's side.
BLOCK = 64


def densify(traces: DataFrame, step: float = 2.0, id_col: str = "trace_id") -> DataFrame:
    """Stations every ``step`` metres along polylines (``geom``: array of x, y) and at the end, with chainage and unit normal.

    A trace shorter than two steps gives none.
    """
    g = F.col("geom")
    legs = traces.select(id_col, g, F.posexplode(F.slice(g, 2, F.size(g))).alias("leg", "b")).withColumn("a", F.element_at(g, F.col("leg") + 1))
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    legs = legs.withColumn("len", F.sqrt(dx * dx + dy * dy)).filter("len > 0")
    from pyspark.sql import Window

    w = Window.partitionBy(id_col).orderBy("leg")
    legs = legs.withColumn("end", F.sum("len").over(w)).withColumn("begin", F.col("end") - F.col("len")).withColumn("total", F.sum("len").over(Window.partitionBy(id_col)))
    legs = legs.filter(F.col("total") >= 2 * step)
    last = F.col("end") >= F.col("total") - 1e-9
    n0, n1 = F.ceil(F.col("begin") / step - 1e-9), F.ceil(F.col("end") / step - 1e-9) - 1
    marks = F.when(n1 >= n0, F.transform(F.sequence(n0, n1), lambda k: k * F.lit(float(step)))).otherwise(F.array().cast("array<double>"))
    marks = F.filter(marks, lambda c: c < F.col("total") - 1e-9)
    marks = F.when(last, F.concat(marks, F.array("total"))).otherwise(marks)
    st = legs.withColumn("chainage", F.explode(marks)).withColumn("t", (F.col("chainage") - F.col("begin")) / F.col("len"))
    st = st.select(id_col, "chainage", (F.col("a.x") + F.col("t") * (F.col("b.x") - F.col("a.x"))).alias("x"), (F.col("a.y") + F.col("t") * (F.col("b.y") - F.col("a.y"))).alias("y"))
    o = Window.partitionBy(id_col).orderBy("chainage")
    px, py = F.coalesce(F.lag("x").over(o), F.col("x")), F.coalesce(F.lag("y").over(o), F.col("y"))
    qx, qy = F.coalesce(F.lead("x").over(o), F.col("x")), F.coalesce(F.lead("y").over(o), F.col("y"))
    st = st.withColumn("station", F.row_number().over(o)).withColumn("__tx", qx - px).withColumn("__ty", qy - py)
    norm = F.sqrt(F.col("__tx") * F.col("__tx") + F.col("__ty") * F.col("__ty"))
    return st.withColumn("nx", F.when(norm > 0, -F.col("__ty") / norm).otherwise(0.0)).withColumn("ny", F.when(norm > 0, F.col("__tx") / norm).otherwise(1.0)).drop("__tx", "__ty")


def cross_profiles(stations: DataFrame, cells: DataFrame | blocks.Blocks, grid: dict, band: str = "z", half: float = 8.0, step: float = 0.5, method: str = "bilinear", id_col: str = "trace_id") -> DataFrame:
    """One row a station with ``z``: values across it from left (negative) to right, ``2 * half / step + 1`` of them; null where there is none.

    ``cells`` may be blocks with ``band`` and a halo that reaches the profiles' ends.
    """
    raster = cells if isinstance(cells, blocks.Blocks) else blocks.Blocks.of(cells, grid, [band], BLOCK, math.ceil(half / grid["res"]) + 2)
    return blocks.profiles(raster, stations.select(id_col, "station", "chainage", "x", "y", "nx", "ny"), band, half, step, method).drop("nx", "ny")


def moving_mean(v: np.ndarray, width: int) -> np.ndarray:
    """Centred mean that ignores NaN and shrinks at the ends."""
    h = (width - 1) // 2
    if h < 1:
        return v
    ok = np.isfinite(v)
    s = np.concatenate([[0.0], np.cumsum(np.where(ok, v, 0.0))])
    n = np.concatenate([[0], np.cumsum(ok)])
    lo, hi = np.maximum(np.arange(len(v)) - h, 0), np.minimum(np.arange(len(v)) + h + 1, len(v))
    count = n[hi] - n[lo]
    return np.where(count > 0, (s[hi] - s[lo]) / np.maximum(count, 1), np.nan)


def line_fits(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intercept, slope and squared error of the least-squares line through the first k points, for every k, from running sums."""
    n = np.arange(1, len(x) + 1)
    sx, sy, sxx, sxy, syy = (np.cumsum(a) for a in (x, y, x * x, x * y, y * y))
    vx = sxx - sx * sx / n
    with np.errstate(all="ignore"):
        slope = np.where(vx > 1e-12, (sxy - sx * sy / n) / vx, 0.0)
    cut = (sy - slope * sx) / n
    err = np.maximum(syy - sy * sy / n - slope * slope * vx, 0.0)
    return cut, slope, err


def flat_width(z: np.ndarray, off: np.ndarray, tol: float = 0.10, base: float = 1.0, misses: int = 2) -> dict:
    """Where the profile leaves the plane fitted around its centre by more than ``tol``, on either side."""
    mid, step = int(np.argmin(np.abs(off))), off[1] - off[0]
    reach = max(2, round(base / step))
    near = slice(max(0, mid - reach), mid + reach + 1)
    ok = np.isfinite(z[near])
    none = {"width": 0.0, "cross": math.nan, "left": math.nan, "right": math.nan, "il": mid, "ir": mid}
    if ok.sum() < 3:
        return none
    cross, level = np.polyfit(off[near][ok], z[near][ok], 1)
    gap = np.abs(z - (level + cross * off))
    out = {"cross": float(cross)}
    for name, idx, side in (("left", "il", range(mid - 1, -1, -1)), ("right", "ir", range(mid + 1, len(z)))):
        last, missed = mid, 0
        for i in side:
            if np.isfinite(gap[i]) and gap[i] <= tol:
                last, missed = i, 0
            else:
                missed += 1
                if missed > misses:
                    break
        nxt = last + (1 if name == "right" else -1)
        edge = off[last]
        if 0 <= nxt < len(z) and np.isfinite(gap[nxt]) and gap[nxt] > max(tol, gap[last] if np.isfinite(gap[last]) else tol):
            inner = gap[last] if np.isfinite(gap[last]) else 0.0
            edge = off[last] + (tol - inner) / (gap[nxt] - inner) * (off[nxt] - off[last])
        out[name], out[idx] = float(edge), last
    return out | {"width": max(0.0, out["right"] - out["left"])}


def gradient_width(z: np.ndarray, off: np.ndarray, limit: float = 0.15) -> dict:
    """Run of small gradient that holds the centre, else the nearest one."""
    mid = int(np.argmin(np.abs(off)))
    with np.errstate(all="ignore"):
        flat = np.abs(np.gradient(z, off)) <= limit
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flat.astype(np.int8), [0]))))
    runs = list(zip(edges[::2], edges[1::2] - 1))
    if not runs:
        return {"width": 0.0, "cross": math.nan, "left": math.nan, "right": math.nan, "il": mid, "ir": mid}
    a, b = min(runs, key=lambda r: (max(r[0] - mid, mid - r[1], 0), r[0]))
    ok = np.isfinite(z[a : b + 1])
    cross = float(np.polyfit(off[a : b + 1][ok], z[a : b + 1][ok], 1)[0]) if ok.sum() >= 2 else math.nan
    return {"width": float(off[b] - off[a]), "cross": cross, "left": float(off[a]), "right": float(off[b]), "il": int(a), "ir": int(b)}


def carriageway_width(z: np.ndarray, raw: np.ndarray, off: np.ndarray, tol: float = 0.10, least: float = 0.75, contrast: float = 0.012, f_least: float = 4.0) -> dict:
    """Platform edges drawn in to the break between carriageway and shoulder, where two lines fit the raw profile clearly better than one."""
    plat = flat_width(z, off, tol)
    if plat["width"] <= 0:
        return plat | {"clear": 0}
    mid, clear = int(np.argmin(np.abs(off))), 0
    out = dict(plat)
    for name, sign, stop in (("left", -1, plat["il"]), ("right", 1, plat["ir"])):
        idx = np.arange(mid, stop + sign, sign)
        idx = idx[np.isfinite(raw[idx])]
        x, y, edge = np.abs(off[idx]), raw[idx], abs(plat[name])
        n = len(x)
        lo, hi = max(3, int((x <= least).sum())), n - 3
        if n < 8 or hi <= lo:
            continue
        a1, b1, e1 = line_fits(x, y)
        a2, b2, e2 = (v[::-1] for v in line_fits(x[::-1], y[::-1]))
        ks = np.arange(lo, hi + 1)  # the first k points are carriageway
        k = int(ks[np.argmin(e1[ks - 1] + e2[ks])])
        sse, whole = e1[k - 1] + e2[k], e1[-1]
        f = ((whole - sse) / 2) / (max(sse, 1e-14) / (n - 4)) if n > 4 else 0.0
        p1, p2 = b1[k - 1], b2[k]
        if f < f_least or abs(p2 - p1) < contrast or abs(p2) <= abs(p1):
            continue
        cross = (a1[k - 1] - a2[k]) / (p2 - p1)
        if least <= cross <= edge:
            out[name] = sign * float(cross)
            clear += 1
    return out | {"width": out["right"] - out["left"], "clear": clear}


def has_ditch(z: np.ndarray, edge: int, sign: int, step: float, depth: float = 0.2) -> bool:
    """Whether within four metres beyond an edge the ground drops by ``depth`` and rises as much again."""
    idx = edge + sign * np.arange(1, max(1, round(4 / step)) + 1)
    idx = idx[(idx >= 0) & (idx < len(z))]
    idx = idx[np.isfinite(z[idx])]
    if len(idx) < 2 or not np.isfinite(z[edge]):
        return False
    v = z[idx]
    after = np.maximum.accumulate(v[::-1])[::-1]
    return bool(((z[edge] - v >= depth) & (after - v >= depth)).any())


def read_profile(raw: np.ndarray, off: np.ndarray, method: str = "chaussee", tol: float = 0.10, limit: float = 0.15, depth: float = 0.2, width: int = 3) -> dict:
    """Width, edges, cross slope and ditches of one profile."""
    z = moving_mean(raw, width)
    m = {"chaussee": lambda: carriageway_width(z, raw, off, tol), "planeite": lambda: flat_width(z, off, tol), "gradient": lambda: gradient_width(z, off, limit)}[method]()
    step = off[1] - off[0]
    if m["width"] <= 0:
        return {"LARGEUR_ROULABLE": 0.0, "BORD_G": None, "BORD_D": None, "BORDS_CHAUSSEE": m.get("clear"), "DEVERS": m["cross"], "FOSSES": 0}
    ditches = int(has_ditch(z, m["il"], -1, step, depth)) + int(has_ditch(z, m["ir"], 1, step, depth))
    return {"LARGEUR_ROULABLE": m["width"], "BORD_G": -m["left"], "BORD_D": m["right"], "BORDS_CHAUSSEE": m.get("clear"), "DEVERS": m["cross"], "FOSSES": ditches}


_READ = "LARGEUR_ROULABLE double, BORD_G double, BORD_D double, BORDS_CHAUSSEE int, DEVERS double, FOSSES int"


def measure(profiles: DataFrame, half: float = 8.0, step: float = 0.5, method: str = "chaussee", tol: float = 0.10, base: float = 30.0, id_col: str = "trace_id") -> DataFrame:
    """Stations with width, edges, cross slope, ditches, longitudinal slope and radius.

    Profiles are independent of each other, so they are read in Arrow batches
    without a shuffle; slope and radius are windows along the trace.
    """
    n = round(half / step)
    off = np.arange(-n, n + 1) * step

    def run(frames):
        for pdf in frames:
            got = [read_profile(np.array([np.nan if v is None else v for v in z], float), off, method, tol) for z in pdf["z"]]
            out = pd.DataFrame(got, columns=[c.split()[0] for c in _READ.split(", ")])
            for c in ("BORDS_CHAUSSEE", "FOSSES"):
                out[c] = out[c].astype("Int32")
            yield pd.concat([pdf[[id_col, "station", "chainage", "x", "y"]].reset_index(drop=True), pdf["z"].map(lambda z: z[n]).rename("z_axe").astype(float).reset_index(drop=True), out], axis=1)

    st = profiles.mapInPandas(run, f"{id_col} long, station int, chainage double, x double, y double, z_axe double, {_READ}")
    st = st.withColumn("z_lisse", smooth("z_axe", 5, id_col)).withColumn("PENTE_LONG", long_slope("z_lisse", "chainage", id_col)).drop("z_lisse")
    return fitted_radius(st.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("DEVERS", "BORD_G", "BORD_D", "PENTE_LONG")}), base, id_col)


def measure_summary(stations: DataFrame, id_col: str = "trace_id") -> DataFrame:
    """Per trace: median width, mean and greatest slope, least radius and its 5th percentile."""
    finite = F.when(F.col("RAYON_COURBURE") < float("inf"), F.col("RAYON_COURBURE"))
    inf = F.lit(float("inf"))
    return stations.groupBy(id_col).agg(
        F.median("LARGEUR_ROULABLE").alias("LARGEUR_ROULABLE_MED"), F.avg(F.abs("PENTE_LONG")).alias("PENTE_LONG_MOY"), F.max(F.abs("PENTE_LONG")).alias("PENTE_LONG_MAX"),
        F.coalesce(F.min(finite), inf).alias("RAYON_COURBURE_MIN"), F.coalesce(F.percentile(finite, F.lit(0.05)), inf).alias("RAYON_COURBURE_P05"),
    )


def open_run(v: np.ndarray, off: np.ndarray, limit: float) -> tuple[float, float, bool]:
    """Left and right reach of the run around the centre where values stay at or below ``limit``, edges interpolated; whether it meets an end."""
    mid = int(np.argmin(np.abs(off)))
    if not np.isfinite(v[mid]) or v[mid] > limit:
        return 0.0, 0.0, False
    reach, cut = [], False
    for sign in (-1, 1):
        i = mid
        while 0 <= i + sign < len(v) and np.isfinite(v[i + sign]) and v[i + sign] <= limit:
            i += sign
        if 0 <= i + sign < len(v):
            nxt = v[i + sign]
            f = min(1.0, max(0.0, (limit - v[i]) / (nxt - v[i]))) if np.isfinite(nxt) and nxt > v[i] else 0.0
            reach.append(abs(off[i] + f * (off[i + sign] - off[i])))
        else:
            reach.append(abs(off[i]))
            cut = True
    return reach[0], reach[1], cut


def lateral_clearance(profiles: DataFrame, widths: DataFrame, nearest: DataFrame | None = None, half: float = 8.0, step: float = 0.5, limit: float = 2.0, id_col: str = "trace_id") -> DataFrame:
    """Open width under the canopy: ``LARGEUR_DEGAGEE, DEGAGE_G, DEGAGE_D, TRONQUE, SURPLOMB, HAUT_SURPLOMB``.

    ``profiles`` samples canopy height bilinearly; ``nearest`` (by default the
    same) gives the heights that hang over the road of ``widths``
    (``LARGEUR_ROULABLE``).
    """
    n = round(half / step)
    off = np.arange(-n, n + 1) * step
    over = (nearest or profiles).select(id_col, "station", F.col("z").alias("zn"))
    rows = profiles.select(id_col, "station", "z").join(over, [id_col, "station"]).join(widths.select(id_col, "station", "LARGEUR_ROULABLE"), [id_col, "station"])

    def run(frames):
        for pdf in frames:
            out = []
            for z, zn, w in zip(pdf["z"], pdf["zn"], pdf["LARGEUR_ROULABLE"]):
                v, vn = (np.array([np.nan if x is None else x for x in a], float) for a in (z, zn))
                g, d, cut = open_run(v, off, limit)
                shut = (np.abs(off) <= w / 2 + 1e-9) & (vn > limit)
                out.append((g + d, g, d, cut, max(0.0, w - g - d), float(vn[shut].min()) if shut.any() else math.inf))
            got = pd.DataFrame(out, columns=["LARGEUR_DEGAGEE", "DEGAGE_G", "DEGAGE_D", "TRONQUE", "SURPLOMB", "HAUT_SURPLOMB"])
            yield pd.concat([pdf[[id_col, "station"]].reset_index(drop=True), got], axis=1)

    return rows.mapInPandas(run, f"{id_col} long, station int, LARGEUR_DEGAGEE double, DEGAGE_G double, DEGAGE_D double, TRONQUE boolean, SURPLOMB double, HAUT_SURPLOMB double")


def mineral_width(profiles: DataFrame, threshold: float, half: float = 8.0, step: float = 0.2, width: int = 5, id_col: str = "trace_id") -> DataFrame:
    """Width of the run of low vegetation index around the axis; null where it meets the profile's end."""
    n = round(half / step)
    off = np.arange(-n, n + 1) * step

    def run(frames):
        for pdf in frames:
            out = []
            for z in pdf["z"]:
                v = moving_mean(np.array([np.nan if x is None else x for x in z], float), width)
                g, d, cut = open_run(v, off, threshold)
                out.append((None if cut else g + d, cut, None if np.isnan(v[n]) else float(v[n])))
            yield pd.concat([pdf[[id_col, "station"]].reset_index(drop=True), pd.DataFrame(out, columns=["LARGEUR_NDVI", "TRONQUE", "NDVI_AXE"]).astype({"LARGEUR_NDVI": float, "NDVI_AXE": float})], axis=1)

    got = profiles.select(id_col, "station", "z").mapInPandas(run, f"{id_col} long, station int, LARGEUR_NDVI double, TRONQUE boolean, NDVI_AXE double")
    return got.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("LARGEUR_NDVI", "NDVI_AXE")})
