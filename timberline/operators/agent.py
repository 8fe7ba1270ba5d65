"""A driver that follows conductivity from seeds, and rounds of drivers.

Rounds are bulk-synchronous: every seed of a round sees the same frozen
network, so the result does not depend on the order of seeds. Drives are
grouped by the tile they are on, with a halo that holds all a step looks at. A
drive whose next step would look beyond is handed to the tile it has come to,
with all it knows of its way, and goes on there in the same round: lines
are the same for any size of tiles.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators.curves import GEOM, as_array, as_geom, length, sinuosity
from timberline.operators.network import greedy_cover
from timberline.operators.pathfind import least_cost
from timberline.operators.skeleton import border_runs
from timberline.session import materialize, release


# How a fan of costs is smoothed and what a trough may cost.
#: Width of the first running mean for fans of more than so many directions, widest first; the second is of width 5.
SMOOTHING = ((36, 9), (18, 5), (0, 3))
SECOND_WIDTH = 5
#: Least number of directions that are judged, and the least cost of a direction that cannot be reached.
LEAST_FAN, UNREACHED = 6, 99_999.0
#: A trough may cost 1 time what is allowed at a depth of 50, and 2.5 times at 400 and beyond, linear in between and below.
DEPTHS, ALLOWANCES = (50.0, 400.0), (1.0, 2.5)
# Fixed values end here.


def fan(reach: float, fov: float, res: float) -> np.ndarray:
    """Angles of a fan, the same on both sides of straight ahead, a step and a half of cells apart at its rim."""
    step = max(1, math.floor(1.5 * res / reach * 180 / math.pi))
    side = np.arange(step, fov / 2 + 1e-9, step)
    return np.radians(np.concatenate([-side[::-1], [0.0], side]))


def running(v: np.ndarray, width: int) -> np.ndarray:
    """Mean over ``width`` neighbours, over fewer at the ends."""
    ones = np.ones(width)
    return np.convolve(v, ones, "full")[width // 2 :][: len(v)] / np.convolve(np.ones(len(v)), ones, "full")[width // 2 :][: len(v)]


def directions(cost: np.ndarray, allowed: float) -> list[tuple[int, float]]:
    """Where a fan's costs have troughs: ``(direction, relative cost)``, cheapest first.

    The smoothed fan falls towards each of its troughs from the next ridge on
    either side; between these ridges the cheapest direction of the fan itself
    is taken. How far it lies below the mean of the two ridges is the trough's
    depth; a deeper trough may cost more. Relative costs of one and less are
    affordable: only these are given, or the cheapest where none is.
    """
    n, known = len(cost), np.isfinite(cost)
    if n < LEAST_FAN or not known.any():
        return []
    c = np.where(known, cost, max(UNREACHED, cost[known].max()))
    s = running(running(c, next(w for over, w in SMOOTHING if n > over)), SECOND_WIDTH)
    falls, at = np.diff(s) < 0, np.arange(n)
    climbs = np.diff(s) > 0
    troughs = 1 + np.flatnonzero(falls[:-1] & ~falls[1:])
    # the last ridge before each direction, and the first after it
    before = np.maximum.accumulate(np.where(np.concatenate([[True], climbs]), at, 0))
    after = np.minimum.accumulate(np.where(np.concatenate([falls, [True]]), at, n - 1)[::-1])[::-1]
    found = {}
    for left, right in dict.fromkeys((int(before[i]), int(after[i])) for i in troughs):
        k = left + int(c[left : right + 1].argmin())
        depth = (c[left] + c[right]) / 2 - c[k]
        slope = (ALLOWANCES[1] - ALLOWANCES[0]) / (DEPTHS[1] - DEPTHS[0])
        allowance = min(ALLOWANCES[0] + (depth - DEPTHS[0]) * slope, ALLOWANCES[1])
        found.setdefault(k, float(c[k] / (allowance * allowed)))
    ranked = sorted(found.items(), key=lambda f: (c[f[0]], f[0]))
    return [f for f in ranked if f[1] <= 1] or ranked[:1]


class Ground:
    """A raster with its place, and what lies on it."""

    def __init__(self, sigma: np.ndarray, x0: float, y1: float, res: float, passable: np.ndarray | None = None):
        self.sigma, self.x0, self.y1, self.res, self.passable = sigma, x0, y1, res, passable
        rows, cols = sigma.shape
        self.cx, self.cy = x0 + (np.arange(cols) + 0.5) * res, y1 - (np.arange(rows) + 0.5) * res

    def cell(self, x: float, y: float) -> tuple[int, int] | None:
        r, c = math.floor((self.y1 - y) / self.res), math.floor((x - self.x0) / self.res)
        return (r, c) if 0 <= r < self.sigma.shape[0] and 0 <= c < self.sigma.shape[1] else None

    def point(self, cell: tuple[int, int]) -> tuple[float, float]:
        return float(self.cx[cell[1]]), float(self.cy[cell[0]])

    def holds(self, at, reach: float, grid: dict) -> bool:
        """Whether all of the grid's ground within ``reach`` of a point is here."""
        rows, cols = self.sigma.shape
        eps = 1e-6 * self.res
        return (max(at[0] - reach, grid["xmin"]) >= self.x0 - eps and min(at[0] + reach, grid["xmin"] + grid["ncol"] * self.res) <= self.x0 + cols * self.res + eps
                and min(at[1] + reach, grid["ymax"]) <= self.y1 + eps and max(at[1] - reach, grid["ymax"] - grid["nrow"] * self.res) >= self.y1 - rows * self.res - eps)

    def near(self, line: np.ndarray, reach: float, box: tuple[slice, slice], flat: bool = False) -> np.ndarray:
        """Cells of the box within ``reach`` of a polyline; ``flat`` leaves out what lies beyond its ends."""
        xs, ys = np.meshgrid(self.cx[box[1]], self.cy[box[0]])
        out = np.zeros(xs.shape, bool)
        for k, (a, b) in enumerate(zip(line[:-1], line[1:])):
            d = b - a
            n = float(d @ d)
            if n == 0:
                continue
            t = ((xs - a[0]) * d[0] + (ys - a[1]) * d[1]) / n
            e = np.clip(t, 0, 1)
            hit = np.hypot(xs - a[0] - e * d[0], ys - a[1] - e * d[1]) <= reach
            if flat and k == 0:
                hit &= t >= 0
            if flat and k == len(line) - 2:
                hit &= t <= 1
            out |= hit
        return out


def drive(ground: Ground, seed: np.ndarray, known: list[np.ndarray] = (), grid: dict | None = None, way: dict | None = None, reach: float = 100.0, fov: float = 160.0, wanted: float = 0.6, floor: float = 0.1,
          buffer: float = 10.0, advance: float = 0.8, gap_max: float = 2.5, steps: int = 500, passable_min: float = 0.45) -> dict:
    """Follow the ground from a seed (two points; it heads from the first to the second).

    Each step looks at a fan of directions, takes the cheapest minimum and
    goes most of the way there; other minima become seeds. It ends at the
    ground's border, at a known line, without a direction, or when steps over
    cost add up to more than ``gap_max`` reaches; those steps are taken back.
    Where ``grid`` tells that there is more ground than is here, a drive that needs
    it stops with ``suite``, and what it returns is the ``way`` to go on from.
    """
    way = way or {"route": seed[-1:].astype(float), "cuts": [1], "over": 0, "behind": 0.0, "heading": math.atan2(*(seed[-1] - seed[0])[::-1])}
    route = way["route"]
    pieces = [route[a:b] for a, b in zip([0, *way["cuts"]], way["cuts"])]
    start, position, heading = route[0], route[-1], way["heading"]
    over, behind, branches, why = way["over"], way["behind"], [], "max_pas"
    for _ in range(len(pieces) - 1, steps):
        if grid is not None and not ground.holds(position, reach + 4 * buffer, grid):
            why = "suite"
            break
        r, window, ends, angles = reach, None, None, None
        for _try in range(3):
            angles = fan(r, fov, ground.res)
            ends = position + r * np.stack([np.cos(heading + angles), np.sin(heading + angles)], axis=1)
            cells = [ground.cell(*e) for e in ends]
            if all(c is not None and not np.isnan(ground.sigma[c]) for c in cells):
                window = cells
                break
            r /= 2
            if r < 4 * ground.res:
                break
        if window is None:
            why = "hors_emprise"
            break
        lo, hi = np.minimum(ends.min(axis=0), position) - 3 * buffer, np.maximum(ends.max(axis=0), position) + 3 * buffer
        rows = slice(max(0, math.floor((ground.y1 - hi[1]) / ground.res)), min(ground.sigma.shape[0], math.ceil((ground.y1 - lo[1]) / ground.res) + 1))
        cols = slice(max(0, math.floor((lo[0] - ground.x0) / ground.res)), min(ground.sigma.shape[1], math.ceil((hi[0] - ground.x0) / ground.res) + 1))
        view = ground.sigma[rows, cols].copy()
        view[view < floor] = floor
        if ground.passable is not None:
            view[ground.passable[rows, cols] < passable_min] = floor
        xs, ys = np.meshgrid(ground.cx[cols], ground.cy[rows])
        hole = np.hypot(xs - start[0], ys - start[1]) <= buffer
        for line in known:
            view[ground.near(line, buffer, (rows, cols)) & ~hole] = np.nan
        track = np.concatenate(pieces[:-1]) if len(pieces) > 1 else None
        if track is not None and len(track) > 1:
            view[ground.near(track, buffer, (rows, cols), True) & ~np.isnan(view)] = floor / 10
        here = ground.cell(*position)
        local = (here[0] - rows.start, here[1] - cols.start)
        cost, _ = least_cost(view, local, None, headings=1, turning=0.0, sigma_min=floor / 10, res=ground.res)
        if np.isnan(cost[local]):
            why = "depart_infranchissable"
            break

        def at(points, cost=cost, rows=rows, cols=cols):
            out = []
            for p in points:
                c = ground.cell(*p)
                a, b = (c[0] - rows.start, c[1] - cols.start) if c else (-1, -1)
                v = cost[a, b] if 0 <= a < cost.shape[0] and 0 <= b < cost.shape[1] else np.nan
                out.append(np.inf if np.isnan(v) else v)
            return np.array(out)

        values, open_reach = at(ends), r
        if known and not np.isfinite(values).all():
            while r > 4 * ground.res and not np.isfinite(values).all():
                r /= 2
                angles = fan(r, fov, ground.res)
                ends = position + r * np.stack([np.cos(heading + angles), np.sin(heading + angles)], axis=1)
                values = at(ends)
            if not np.isfinite(values).all():
                why = "reseau_rejoint"
                break
        best = directions(values, r / wanted)
        if not best:
            # a reach cut short by a known line leaves too few directions: the line is reached
            why = "reseau_rejoint" if r < open_reach else "aucune_direction"
            break
        goal = ground.cell(*ends[best[0][0]])
        _, path = least_cost(view, local, (goal[0] - rows.start, goal[1] - cols.start), headings=1, turning=0.0, sigma_min=floor / 10, res=ground.res)
        if not path:
            why = "chemin_introuvable"
            break
        xy = np.array([ground.point((a + rows.start, b + cols.start)) for a, b in path])
        xy = xy[: max(2, math.floor(len(xy) * advance))]
        for k, _rel in best[1:]:
            if math.degrees(abs(angles[k] - angles[best[0][0]])) > 15:
                a = heading + angles[k]
                branches.append(np.array([position, position + 0.35 * r * np.array([math.cos(a), math.sin(a)])]))
        pieces.append(xy[1:])
        if best[0][1] > 1:
            behind += r
            over += 1
            if behind > gap_max * reach:
                why = "trouee_trop_longue"
                break
        else:
            behind, over = 0.0, 0
        position = xy[-1]
        back = xy[max(0, len(xy) - 4)]
        heading = math.atan2(position[1] - back[1], position[0] - back[0])
    if over and len(pieces) > 1 and why != "suite":
        pieces = pieces[: max(1, len(pieces) - over)]
    return {"route": np.concatenate(pieces), "branches": branches, "why": why, "legs": len(pieces) - 1, "cuts": np.cumsum([len(p) for p in pieces]).tolist(),
            "over": over, "behind": behind, "heading": heading}


def seeds(cells: DataFrame, grid: dict, reference: DataFrame | None = None, level: float = 0.6, size: float = 20.0, border: bool = True, band: str = "p") -> DataFrame:
    """Seeds ``(x0, y0, x1, y1)``: outward at both ends of each reference line, and inward at each strong run along the border. The end must lie on the grid."""
    out = None
    if reference is not None:
        d = F.sqrt((F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1")))
        ref = reference.withColumn("__d", d).filter("__d > 0").withColumn("ux", (F.col("x2") - F.col("x1")) / F.col("__d")).withColumn("uy", (F.col("y2") - F.col("y1")) / F.col("__d"))
        both = F.explode(F.array(
            F.struct((F.col("x1") + size * F.col("ux")).alias("x0"), (F.col("y1") + size * F.col("uy")).alias("y0"), F.col("x1").alias("xe"), F.col("y1").alias("ye")),
            F.struct((F.col("x2") - size * F.col("ux")).alias("x0"), (F.col("y2") - size * F.col("uy")).alias("y0"), F.col("x2").alias("xe"), F.col("y2").alias("ye")),
        ))
        out = ref.select(both.alias("s")).select("s.x0", "s.y0", F.col("s.xe").alias("x1"), F.col("s.ye").alias("y1"))
    if border:
        b = border_runs(cells, grid, level, band)
        b = b.select((F.col("x") - size * F.col("hx")).alias("x0"), (F.col("y") - size * F.col("hy")).alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
        out = b if out is None else out.union(b)
    res = grid["res"]
    spot = out.withColumn("row", F.floor((grid["ymax"] - F.col("y1")) / res).cast("int")).withColumn("col", F.floor((F.col("x1") - grid["xmin"]) / res).cast("int"))
    return spot.join(cells.filter(F.col(band).isNotNull()).select("row", "col"), ["row", "col"], "left_semi").select("x0", "y0", "x1", "y1").distinct()


_WAY = "struct<cuts: array<int>, over: int, behind: double, heading: double>"
_DRIVES = f"round int, why string, legs int, branches array<array<double>>, way {_WAY}, {GEOM}"


def vectorise(cells: DataFrame, grid: dict, reference: DataFrame | None = None, level: float = 0.6, length_min: float = 30.0, sinuosity_max: float = 1.8, rounds: int = 10,
              tile: int = 512, halo: int | None = None, band: str = "p", passable: str | None = None, **driving) -> DataFrame:
    """Lines ``(id, round, why, geom)`` found by rounds of drivers.

    A drive counts if it moved, is ``length_min`` long and not too winding;
    its branches seed the next round. Lines found in a round that run within
    the buffer of an earlier one of that round (longest first) are left out.
    Within a round, a tile's known lines are those that come near it. A halo
    (in cells) must hold all that a step looks at: the reach and four buffers, which is the default.
    """
    res, buffer = grid["res"], driving.get("buffer", 10.0)
    looked = driving.get("reach", 100.0) + 4 * buffer
    halo = math.ceil(looked / res) + 1 if halo is None else halo
    if halo * res < looked:
        raise ValueError("a halo is at least the reach and four buffers wide")
    bands = [band] + ([passable] if passable else [])
    rows, cols = (grid["nrow"] - 1) // tile, (grid["ncol"] - 1) // tile
    span = lambda v, n: F.sequence(F.greatest(F.floor((v - halo) / tile), F.lit(0)).cast("int"), F.least(F.floor((v + halo) / tile), F.lit(n)).cast("int"))
    sent = materialize(cells.select("row", "col", *bands).withColumn("tr", F.explode(span(F.col("row"), rows))).withColumn("tc", F.explode(span(F.col("col"), cols))))
    inside = lambda v, n: F.least(F.greatest(F.floor(v / res / tile), F.lit(0)), F.lit(n)).cast("int")
    tile_row, tile_col = lambda y: inside(grid["ymax"] - y, rows), lambda x: inside(x - grid["xmin"], cols)
    known = None
    if reference is not None:
        known = reference.select(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))).alias("geom"))
    no_way = F.lit(None).cast(_WAY)
    seeded = lambda df: df.select(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))).alias("geom"), no_way.alias("way"))
    ask = materialize(seeded(seeds(cells, grid, reference, level, band=band)))
    found = None
    for k in range(rounds):
        lines = known if found is None else (found.select("geom") if known is None else known.union(found.select("geom")))
        ended, going, held = None, ask, []
        while not going.isEmpty():  # until every drive of the round has come to its end
            last = F.element_at("geom", -1)
            keyed = going.select(tile_row(last["y"]).alias("tr"), tile_col(last["x"]).alias("tc"), F.lit(0).alias("what"), "geom", "way")
            work = keyed
            if lines is not None:
                box = lambda f, c: f(F.transform("geom", lambda p: p[c]))
                m = halo * res
                tr = F.sequence(tile_row(box(F.array_max, "y") + m), tile_row(box(F.array_min, "y") - m))
                tc = F.sequence(tile_col(box(F.array_min, "x") - m), tile_col(box(F.array_max, "x") + m))
                near = lines.withColumn("tr", F.explode(tr)).withColumn("tc", F.explode(tc)).select("tr", "tc", F.lit(1).alias("what"), "geom", no_way.alias("way"))
                work = work.union(near.join(keyed.select("tr", "tc").distinct(), ["tr", "tc"], "left_semi"))
            got = materialize(sent.groupBy("tr", "tc").cogroup(work.groupBy("tr", "tc")).applyInPandas(_drivers(k, grid, tile, halo, bands, passable, length_min, sinuosity_max, driving), _DRIVES))
            done = got.filter("why <> 'suite'")
            held.append(got)
            ended = done if ended is None else ended.union(done)
            before, going = going, materialize(got.filter("why = 'suite'").select("geom", "way"))
            release(before)
        release(going)
        if ended is None:
            break
        ended = materialize(ended)
        for got in held:
            release(got)
        new = _apart(ended.filter("legs > 0").select("round", "why", "geom"), buffer)
        before, found = found, materialize(new if found is None else found.union(new))
        release(before)
        b = ended.select(F.explode("branches").alias("b")).select(*[F.col("b")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]).distinct()
        ask = materialize(seeded(b))
        release(ended)
    release(ask)
    release(sent)
    if found is None:
        return cells.sparkSession.createDataFrame([], f"id long, round int, why string, {GEOM}")
    return found.select(F.xxhash64(F.to_json("geom")).alias("id"), "round", "why", "geom")


def _drivers(k: int, grid: dict, tile: int, halo: int, bands: list[str], passable: str | None, length_min: float, sinuosity_max: float, driving: dict):
    """The round ``k`` on one tile: its cells, and its drives (0) and known lines (1). Branches are given where the drive made them, lines at its end."""
    res = grid["res"]

    def run(key: tuple, ground_rows: pd.DataFrame, jobs: pd.DataFrame) -> pd.DataFrame:
        cols = ["round", "why", "legs", "branches", "way", "geom"]
        if not len(ground_rows) or not (jobs["what"] == 0).any():
            return pd.DataFrame(columns=cols)
        # cells that the table lacks are holes in the ground, not beyond it
        r0, c0 = (max(0, int(t) * tile - halo) for t in key)
        r1, c1 = (min(grid[n], (int(t) + 1) * tile + halo) for t, n in zip(key, ("nrow", "ncol")))
        shape = (r1 - r0, c1 - c0)
        layers = []
        for b in bands:
            a = np.full(shape, np.nan)
            a[ground_rows.row - r0, ground_rows.col - c0] = ground_rows[b].to_numpy(dtype=float)
            layers.append(a)
        ground = Ground(layers[0], grid["xmin"] + c0 * res, grid["ymax"] - r0 * res, res, layers[1] if passable else None)
        walls = [as_array(g) for g in jobs.loc[jobs["what"] == 1, "geom"]]
        mine = jobs[jobs["what"] == 0]
        out = []
        for geom, held in sorted(((as_array(g).tolist(), w) for g, w in zip(mine["geom"], mine["way"])), key=lambda x: x[0]):
            a = np.array(geom)
            if ground.cell(*a[-1]) is None:
                continue
            way = None
            if held is not None:
                way = {"route": a, "cuts": [int(x) for x in held["cuts"]], "over": int(held["over"]), "behind": float(held["behind"]), "heading": float(held["heading"])}
            got = drive(ground, a, walls, grid, way, **driving)
            branches = [list(map(float, b.ravel())) for b in got["branches"]]
            if got["why"] == "suite":
                out.append((k, "suite", 0, [], {x: got[x] for x in ("cuts", "over", "behind", "heading")}, as_geom(got["route"])))
                out.append((k, "amorces", 0, branches, None, []))
            elif got["legs"] >= 1 and length(got["route"]) >= length_min and sinuosity(got["route"]) <= sinuosity_max:
                out.append((k, got["why"], got["legs"], branches, None, as_geom(got["route"])))
        return pd.DataFrame(out, columns=cols)

    return run


def _apart(lines: DataFrame, buffer: float) -> DataFrame:
    """Of a round's lines, longest first, those of whose points less than 0.7 lie within half a buffer of one kept."""
    from timberline.functions.geometry import line_length, point_segment_distance

    geom = F.col("geom")
    named = materialize(lines.withColumn("__id", F.xxhash64(F.to_json("geom"))).withColumn("__size", line_length("geom")).dropDuplicates(["__id"]))
    r, side = buffer / 2, F.lit(2.0 * buffer)
    n = F.size(geom)
    points = named.select("__id", "__size", n.alias("n"), F.posexplode("geom").alias("k", "p")).select("__id", "__size", "n", "k", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    pairs = F.arrays_zip(F.slice(geom, F.lit(1), n - 1).alias("a"), F.slice(geom, F.lit(2), n - 1).alias("b"))
    pieces = named.filter(n > 1).select("__id", "__size", F.explode(pairs).alias("s")).select(
        F.col("__id").alias("__b"), F.col("__size").alias("__bs"), F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))
    cover = lambda a, b: F.sequence(F.floor((F.least(a, b) - r) / side).cast("long"), F.floor((F.greatest(a, b) + r) / side).cast("long"))
    laid = pieces.withColumn("gx", F.explode(cover(F.col("x1"), F.col("x2")))).withColumn("gy", F.explode(cover(F.col("y1"), F.col("y2"))))
    spots = points.withColumn("gx", F.floor(F.col("x") / side).cast("long")).withColumn("gy", F.floor(F.col("y") / side).cast("long"))
    longer = (F.col("__bs") > F.col("__size")) | ((F.col("__bs") == F.col("__size")) & (F.col("__b") < F.col("__id")))
    met = spots.join(laid, ["gx", "gy"]).filter(longer & (point_segment_distance("x", "y", "x1", "y1", "x2", "y2") <= r))
    covers = met.select(F.col("__id").alias("short"), F.col("__b").alias("long"), (F.col("k") / F.col("n")).alias("lo"), ((F.col("k") + 1) / F.col("n")).alias("hi")).distinct()
    kept = greedy_cover(named.select(F.col("__id").alias("id")), covers, 0.7 - 1e-9)
    return named.join(kept.withColumnRenamed("id", "__id"), "__id", "left_semi").select(lines.columns)
