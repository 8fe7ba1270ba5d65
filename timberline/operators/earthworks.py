"""Cut and fill of a platform laid into the ground, station by station."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators.stations import applicable_length

# Bank slopes tried in turn where the wanted one misses the ground.
HARDER = (0.67, 1.0, 1.5, 4.0)
LOOK = 6.0


def level_point(off: np.ndarray, z: np.ndarray, level: float, width: float, tol: float = 0.05) -> tuple[int | None, bool, int]:
    """Index of the ground nearest the platform's level, whether it is level, and the configuration (1 on the axis, 2 beside it, 3 and 5: ground above or below)."""
    away = np.abs(off - off[int(np.argmin(np.abs(off)))])
    gap = np.abs(z - level)
    for reach in (width / 2, width):
        fit = np.flatnonzero((away <= reach) & (gap <= tol))
        if len(fit):
            i = int(min(fit, key=lambda k: (gap[k], away[k])))
            return i, True, 1 if away[i] < 0.05 else 2
    near = np.flatnonzero((away <= width / 2) & np.isfinite(z))
    if not len(near):
        return None, False, 0
    i = int(near[np.argmin(gap[near])])
    return i, False, 3 if z[i] > level else 5


def shift_into_slope(off: np.ndarray, z: np.ndarray, at: int, level: float, least: float = 0.35, most: float = 0.60) -> dict:
    """Form of the ground around the platform and how far it moves into the cut, 0 to 1."""
    slopes = []
    for sign in (-1, 1):
        j = int(np.argmin(np.abs(off - (off[at] + sign * LOOK))))
        d = abs(off[j] - off[at])
        slopes.append((z[j] - level) / d if d > 1e-9 and np.isfinite(z[j]) else math.nan)
    g, d = slopes
    flat = {"side": 0, "shift": 0.0, "g": g, "d": d}
    if math.isnan(g) or math.isnan(d):
        return flat | {"form": "indetermine"}
    if max(g, d) < 0:
        return flat | {"form": "croupe"}
    if min(g, d) > 0:
        return flat | {"form": "thalweg"}
    side = -1 if g > d else 1
    up, down = (abs(g), abs(d)) if side < 0 else (abs(d), abs(g))
    steep = up if down < most else down
    return {"side": side, "shift": min(1.0, max(0.0, (steep - least) / (most - least))), "g": g, "d": d, "form": "versant"}


def bank(off: np.ndarray, z: np.ndarray, at: int, level: float, slope: float, sign: int, rising: bool, tol: float = 0.05):
    """Indices and heights of a bank from a platform edge to where it meets the ground, its slope, and whether that had to change."""
    idx = np.arange(at - 1, -1, -1) if sign < 0 else np.arange(at + 1, len(off))
    if not len(idx) or (np.isfinite(z[at]) and abs(level - z[at]) <= tol):
        return idx[:0], z[:0], slope, False
    run = np.abs(off[idx] - off[at])

    def meets(s: float, up: bool):
        line = level + (s if up else -s) * run
        way = np.sign(line - z[idx])
        if np.isnan(way[0]):
            return None
        stop = 0 if way[0] == 0 else next(iter(np.flatnonzero(np.isfinite(way) & (way != way[0]))), None)
        return None if stop is None else (idx[: stop + 1], line[: stop + 1])

    for s in (slope, *(h for h in HARDER if h > slope)):
        if (got := meets(s, rising)) is not None:
            return *got, s, s != slope
    if (got := meets(slope, not rising)) is not None:
        return *got, slope, True
    return idx, level + (slope if rising else -slope) * run, slope, True


def earthwork_section(off: np.ndarray, z: np.ndarray, width: float, up: float = 1.0, down: float = 0.6, least: float = 0.35, most: float = 0.60, tol: float = 0.05) -> dict | None:
    """Areas of one profile; None where the ground gives no answer."""
    axis = int(np.argmin(np.abs(off)))
    level = z[axis]
    if not np.isfinite(level):
        return None
    at, found, config = level_point(off, z, level, width, tol)
    if at is None:
        return None
    s = shift_into_slope(off, z, at, level, least, most)
    shift = s["shift"] if found else 0.0
    cut = width / 2 * (1 + shift**2)
    left, right = {-1: (cut, width - cut), 1: (width - cut, cut), 0: (width / 2, width / 2)}[s["side"]]
    il, ir = (int(np.argmin(np.abs(off - v))) for v in (off[at] - left, off[at] + right))
    rise = {"croupe": (False, False), "thalweg": (True, True)}.get(s["form"], (s["side"] < 0, s["side"] > 0))
    road = z.copy()
    road[il : ir + 1] = level
    banks = []
    for edge, sign, rising in ((il, -1, rise[0]), (ir, 1, rise[1])):
        idx, heights, slope, forced = bank(off, z, edge, level, up if rising else down, sign, rising, tol)
        road[idx] = heights
        banks.append((slope, forced))
    step = off[1] - off[0]
    gap = np.where(np.isfinite(z - road), z - road, 0.0)
    changed = np.flatnonzero(np.abs(gap) > 1e-9)
    steepest = max((abs(v) for v in (s["g"], s["d"]) if not math.isnan(v)), default=0.0)
    return {
        "config": config, "ripage": shift, "pente_g": s["g"], "pente_d": s["d"], "assise_deblai": cut, "assise_remblai": width - cut,
        "talus_g": banks[0][0], "talus_d": banks[1][0], "section_deblai": float(gap[gap > 0].sum() * step), "section_remblai": float(-gap[gap < 0].sum() * step),
        "assiette_deblai": float((gap > 0).sum() * step), "assiette_remblai": float((gap < 0).sum() * step),
        "emprise": float((changed[-1] - changed[0] + 1) * step) if len(changed) else 0.0, "forme": s["form"], "talus_force": banks[0][1] or banks[1][1],
        "evacuer": (not found) or steepest > most,
    }


_SECTION = ("config int, ripage double, pente_g double, pente_d double, assise_deblai double, assise_remblai double, talus_g double, talus_d double, section_deblai double, "
            "section_remblai double, assiette_deblai double, assiette_remblai double, emprise double, forme string, talus_force boolean, evacuer boolean")


def earthworks(profiles: DataFrame, width: float = 4.0, half: float = 20.0, step: float = 0.05, up: float = 1.0, down: float = 0.6, rock: float = 0.0, id_col: str = "trace_id") -> DataFrame:
    """Sections, volumes and footprint for each station; profiles without an answer are left out (their length too)."""
    n = round(half / step)
    off = np.arange(-n, n + 1) * step
    names = [c.split()[0] for c in _SECTION.split(", ")]

    def run(frames):
        for pdf in frames:
            got = [earthwork_section(off, np.array([np.nan if v is None else v for v in z], float), width, up, down) for z in pdf["z"]]
            keep = [g is not None for g in got]
            out = pd.DataFrame([g for g in got if g is not None], columns=names)
            yield pd.concat([pdf.loc[keep, [id_col, "station", "chainage", "x", "y", "long_applicable"]].reset_index(drop=True), out], axis=1)

    sized = profiles.withColumn("long_applicable", applicable_length(id_col)).select(id_col, "station", "chainage", "x", "y", "long_applicable", "z")
    got = sized.mapInPandas(run, f"{id_col} long, station int, chainage double, x double, y double, long_applicable double, {_SECTION}")
    v = F.col("long_applicable")
    got = got.withColumn("volume_deblai", F.col("section_deblai") * v).withColumn("volume_remblai", F.col("section_remblai") * v)
    return got.withColumn("volume_evacuer", F.when(F.col("evacuer"), F.col("volume_deblai")).otherwise(0.0)).withColumn("volume_roche", F.col("volume_deblai") * rock / 100).withColumn(
        "surface_emprise", F.col("emprise") * v
    )


def earthworks_summary(points: DataFrame, id_col: str = "trace_id") -> DataFrame:
    sums = ("volume_deblai", "volume_remblai", "volume_evacuer", "volume_roche", "surface_emprise")
    return points.groupBy(id_col).agg(F.count("*").alias("n_points"), F.sum("long_applicable").alias("longueur"), *[F.sum(c).alias(c) for c in sums], F.count_if("talus_force").alias("n_talus_force"))


def platform_share(profiles: DataFrame, width: float = 4.0, half: float = 20.0, step: float = 0.05, slope_min: float = 0.10, ratio: float = 0.5, id_col: str = "trace_id") -> DataFrame:
    """Share of profiles whose inner slope is much less than that of the ground beside them; flat ground abstains."""
    n = round(half / step)
    at = lambda x: F.element_at("z", n + 1 + round(x / step))
    inner = F.abs(at(width / 2) - at(-width / 2)) / width
    outer = (F.abs(at(-width) - at(-width / 2)) + F.abs(at(width) - at(width / 2))) / 2 / (width / 2)
    seen = F.when(outer >= slope_min, (inner < ratio * outer).cast("double"))
    return profiles.groupBy(id_col).agg(F.avg(seen).alias("part_plateforme"))
