"""Least-cost paths over conductivity with heading.

A state is a cell and the heading it was entered with; sixteen moves (eight
neighbours, eight knight's moves) map one to one to sixteen headings.

``Ground`` holds open cells only, of any number of separate areas, as a graph in arrays, and
corrects labels until none falls, whole frontiers at a time. ``reposition`` lays the corridors of
many lines into one ground, so that a line costs what its corridor has in cells, however far its
box reaches. ``cost_field`` spreads costs over a grid of any size: tiles search on their own and hand the
labels that cross a border to the next tile, in rounds, until no label falls. ``least_cost`` is the plain search in a box.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.geometry import legs, point_segment_distance
from timberline.operators.cells import segment_pieces
from timberline.session import materialize, release

#: Cells of the corridors that one group of lines has, about.
CORRIDOR = 250_000
#: (row, column) steps; a knight's move needs the cell between to be open, the straight one along its long side.
MOVES = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]
MOVES += [(dr, dc) for dr in (-2, -1, 1, 2) for dc in (-2, -1, 1, 2) if abs(dr) != abs(dc)]


def heading_of(dr: int, dc: int) -> float:
    """Direction of a move in radians, rows counting downward."""
    return math.atan2(-dr, dc) % (2 * math.pi)


def least_cost(sigma: np.ndarray, start: tuple[int, int], goal: tuple[int, int] | None = None, theta: np.ndarray | None = None,
               weight: np.ndarray | None = None, headings: int = 16, anisotropy: float = 4.0, turning: float = 2.0, sigma_min: float = 0.05,
               res: float = 1.0) -> tuple[np.ndarray, list[tuple[int, int]] | None]:
    """Least cost from ``start`` to every cell (NaN where none), and the path to ``goal`` if one is asked for.

    A step costs the mean resistance of its cells times its length, more the
    further it runs off the local direction ``theta`` (degrees), plus a
    penalty on the square of the turn. NaN cells are closed. With a goal the
    search stops when it is reached, and costs beyond are not final.
    """
    n, m = sigma.shape
    closed = np.isnan(sigma)
    resist = 1.0 / np.maximum(np.where(closed, 1.0, sigma), sigma_min)
    best = np.full((n, m, headings), np.inf)
    came = np.full((n, m, headings), -1, np.int64)
    cost = np.full((n, m), np.nan)
    if closed[start]:
        return cost, None
    unit = 2 * math.pi / headings
    moves = []
    for dr, dc in MOVES:
        d = heading_of(dr, dc)
        between = []
        if max(abs(dr), abs(dc)) == 2:
            between = [(dr - int(math.copysign(1, dr)), dc - int(math.copysign(1, dc)))]
        moves.append((dr, dc, d, round(d / unit) % headings, math.hypot(dr, dc) * res, between))
    heap = []
    for h in range(headings):
        best[start][h] = 0.0
        heap.append((0.0, start[0], start[1], h))
    heapq.heapify(heap)
    end = None
    while heap:
        c, r, k, h = heapq.heappop(heap)
        if c > best[r, k, h]:
            continue
        if np.isnan(cost[r, k]):
            cost[r, k] = c
        if goal is not None and (r, k) == goal:
            end = (r, k, h)
            break
        for dr, dc, d, h2, length, between in moves:
            r2, k2 = r + dr, k + dc
            if not (0 <= r2 < n and 0 <= k2 < m) or closed[r2, k2]:
                continue
            if between and all(closed[r + a, k + b] for a, b in between):
                continue
            step = (resist[r, k] + resist[r2, k2]) / 2 * length
            if theta is not None and weight is not None and weight[r2, k2] > 0 and not math.isnan(theta[r2, k2]):
                gap = abs(math.radians(theta[r2, k2]) - d) % math.pi
                step *= 1 + anisotropy * weight[r2, k2] * math.sin(min(gap, math.pi - gap)) ** 2
            if (r, k) != start:
                turn = abs(h * unit - d) % (2 * math.pi)
                step += turning * min(turn, 2 * math.pi - turn) ** 2
            if c + step < best[r2, k2, h2]:
                best[r2, k2, h2] = c + step
                came[r2, k2, h2] = (r * m + k) * headings + h
                heapq.heappush(heap, (c + step, r2, k2, h2))
    if end is None:
        return cost, None
    path, at = [], end
    while True:
        if not path or path[-1] != at[:2]:
            path.append((at[0], at[1]))
        code = came[at]
        if code < 0:
            break
        at = (int(code) // headings // m, int(code) // headings % m, int(code) % headings)
    return cost, path[::-1]


#: The moves as arrays: steps, direction in radians, length in cells, and the cell beside a knight's move.
_DR, _DC = (np.array([m[i] for m in MOVES]) for i in (0, 1))
_HEADING = np.array([heading_of(*m) for m in MOVES])
_LENGTH = np.array([math.hypot(*m) for m in MOVES])
_SIDE_R, _SIDE_C = (np.where(np.maximum(abs(_DR), abs(_DC)) == 2, d - np.sign(d), 0) for d in (_DR, _DC))


class Ground:
    """Open cells of separate areas, each with its 16 moves: where they lead (-1: nowhere) and what they cost before turning."""

    def __init__(self, area: np.ndarray, row: np.ndarray, col: np.ndarray, sigma: np.ndarray, theta: np.ndarray | None = None, weight: np.ndarray | None = None,
                 headings: int = 16, anisotropy: float = 4.0, turning: float = 2.0, sigma_min: float = 0.05, res: float = 1.0):
        area, row, col = (np.asarray(v, np.int64) for v in (area, row, col))
        self.r0, self.c0 = (int(v.min(initial=0)) - 2 for v in (row, col))
        # room of two cells around, so that no move wraps
        self.wide, self.high = int(col.max(initial=0)) - self.c0 + 3, int(row.max(initial=0)) - self.r0 + 3
        key = self.key(area, row, col)
        order = np.argsort(key, kind="stable")
        self.order, self.keys = order, key[order]
        self.area, self.row, self.col = area[order], row[order], col[order]
        self.headings = headings
        resist = 1.0 / np.maximum(np.asarray(sigma, float)[order], sigma_min)
        offset = _DR * self.wide + _DC
        side = _SIDE_R * self.wide + _SIDE_C
        self.to = np.full((len(order), 16), -1, np.int32)
        self.price = np.zeros((len(order), 16))
        if theta is not None and weight is not None:
            theta, weight = (np.asarray(v, float)[order] for v in (theta, weight))
        for j in range(16):
            t = self.find(self.keys + offset[j])
            if side[j]:
                t = np.where(self.find(self.keys + side[j]) >= 0, t, -1)
            self.to[:, j] = t
            step = (resist + resist[t]) / 2 * (_LENGTH[j] * res)
            if theta is not None and weight is not None:
                gap = np.abs(np.radians(theta[t]) - _HEADING[j]) % math.pi
                slope = 1 + anisotropy * weight[t] * np.sin(np.minimum(gap, math.pi - gap)) ** 2
                step = np.where((weight[t] > 0) & ~np.isnan(theta[t]), step * slope, step)
            self.price[:, j] = step
        unit = 2 * math.pi / headings
        self.enters = np.array([round(d / unit) % headings for d in _HEADING])
        turn = np.abs(np.arange(headings)[:, None] * unit - _HEADING) % (2 * math.pi)
        self.turn = turning * np.minimum(turn, 2 * math.pi - turn) ** 2

    def key(self, area, row, col) -> np.ndarray:
        return (np.asarray(area, np.int64) * self.high + (np.asarray(row, np.int64) - self.r0)) * self.wide + (np.asarray(col, np.int64) - self.c0)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Places of keys among the open cells, -1 where closed."""
        if not len(self.keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def place(self, area, row, col) -> np.ndarray:
        inside = (np.asarray(row) >= self.r0 + 2) & (np.asarray(row) < self.r0 + self.high - 2) & (np.asarray(col) >= self.c0 + 2) & (np.asarray(col) < self.c0 + self.wide - 2)
        return np.where(inside, self.find(self.key(area, row, col)), -1)

    def labels(self) -> np.ndarray:
        return np.full(len(self.keys) * self.headings, np.inf)

    def correct(self, dist: np.ndarray, todo: np.ndarray, free: np.ndarray, goals: np.ndarray | None = None, expand: np.ndarray | None = None) -> None:
        """Lower ``dist`` in place until no move from a state of ``todo`` or after it lowers any label.

        Cells in ``free`` are left without a price on the turn. ``goals`` names the goal's cell for each area, beyond whose cost
        nothing is followed; cells that ``expand`` excludes get labels and pass none on.
        """
        h = self.headings
        typical = float(np.median(self.price[self.to >= 0])) if (self.to >= 0).any() else 1.0
        bound = -np.inf
        while len(todo):
            cost = dist[todo]
            if goals is not None:
                reached = dist.reshape(-1, h)[goals].min(axis=1)
                reached[goals < 0] = np.inf
                go = cost < reached[self.area[todo // h]]
                todo, cost = todo[go], cost[go]
                if not len(todo):
                    break
            near = cost <= bound
            if not near.any():
                bound = float(cost.min()) + 2 * typical
                near = cost <= bound
            now, later = todo[near], todo[~near]
            cell, head = now // h, now % h
            step = self.price[cell] + np.where(free[cell][:, None], 0.0, self.turn[head])
            reach = dist[now][:, None] + step
            to = self.to[cell]
            target = to.astype(np.int64) * h + self.enters
            ok = to >= 0
            target, reach = target[ok], reach[ok]
            better = reach < dist[target]
            target, reach = target[better], reach[better]
            np.minimum.at(dist, target, reach)
            fallen = np.unique(target)
            if expand is not None:
                fallen = fallen[expand[fallen // h]]
            todo = np.union1d(later, fallen)

    def path(self, dist: np.ndarray, goal: int, free: np.ndarray) -> list[int] | None:
        """Cells from a free cell to ``goal`` along labels that add up, or None."""
        h = self.headings
        state = goal * h + int(np.argmin(dist[goal * h : goal * h + h]))
        if not np.isfinite(dist[state]):
            return None
        cells = [goal]
        while not (free[state // h] and dist[state] == 0):
            cell, head = divmod(state, h)
            for j in np.flatnonzero(self.enters == head):
                before = int(self.find(self.keys[cell : cell + 1] - (_DR[j] * self.wide + _DC[j]))[0])
                if before < 0 or self.to[before, j] != cell:
                    continue
                step = self.price[before, j] + (np.zeros(h) if free[before] else self.turn[:, j])
                fits = np.flatnonzero(dist[before * h : before * h + h] + step == dist[state])
                if len(fits):
                    state = before * h + int(fits[0])
                    break
            else:
                raise RuntimeError("labels do not add up")
            if cells[-1] != state // h:
                cells.append(state // h)
        return cells[::-1]


def sparse_paths(ground: Ground, starts: np.ndarray, goals: np.ndarray) -> list[list[int] | None]:
    """For each area the cells of the least-cost path from its start to its goal (places in ``ground``, -1 for none), searched side by side."""
    dist, free = ground.labels(), np.zeros(len(ground.keys), bool)
    ok = (starts >= 0) & (goals >= 0)
    states = (starts[ok][:, None] * ground.headings + np.arange(ground.headings)).ravel()
    dist[states] = 0.0
    free[starts[ok]] = True
    if len(states):
        ground.correct(dist, np.unique(states), free, np.where(ok, goals, -1))
    return [ground.path(dist, int(g), free) if o else None for g, o in zip(goals, ok)]


def cost_field(cells: DataFrame, starts: DataFrame, headings: int = 16, anisotropy: float = 4.0, turning: float = 2.0, sigma_min: float = 0.05,
               res: float = 1.0, tile: int = 256, max_rounds: int = 10_000) -> DataFrame:
    """``(row, col, cost)``: least cost from the nearest of ``starts`` (``row, col``) to every cell that can be reached.

    ``cells`` has ``row, col, sigma`` and may have ``theta, poids``; cells that are missing or have no sigma are closed, starts there start nothing.
    Of cells that come more than once the least sigma counts. A tile and the two cells around it are one row of arrays and one group; a round corrects the
    labels of the tiles into which labels came, and rewrites the tiles' labels once.
    """
    bands = ["sigma"] + [b for b in ("theta", "poids") if b in cells.columns]
    open_cells = cells.filter("row is not null and col is not null and sigma is not null and not isnan(sigma)").groupBy("row", "col").agg(F.min_by(F.struct(*bands), "sigma").alias("v"))
    near = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + d) / tile).cast("long") for d in (-2, 0, 2)]))
    flat = open_cells.select("row", "col", *[F.col(f"v.{b}").cast("double").alias(b) for b in bands])
    placed = flat.withColumn("tr", F.explode(near("row"))).withColumn("tc", F.explode(near("col")))
    schema = "tr long, tc long, kind int, row binary, col binary, bands binary, dist binary, at_row long, at_col long, head int, cost double"
    names = [c.split()[0] for c in schema.split(", ")]

    def blank(key, **more):
        return {"tr": int(key[0]), "tc": int(key[1]), "kind": 0, "row": None, "col": None, "bands": None, "dist": None, "at_row": None, "at_col": None, "head": None, "cost": None, **more}

    def build(key, pdf):
        pdf = pdf.sort_values(["row", "col"])
        block = blank(key, row=pdf.row.to_numpy(np.int64).tobytes(), col=pdf.col.to_numpy(np.int64).tobytes(), bands=np.stack([pdf[b].to_numpy(float) for b in bands]).tobytes())
        block["dist"] = np.full(len(pdf) * headings, np.inf).tobytes()
        return pd.DataFrame([block])[names]

    def search(key, blocks, labels):
        if not len(blocks):
            return pd.DataFrame([], columns=names)
        block = blocks.iloc[0].to_dict()
        row, col = np.frombuffer(block["row"], np.int64), np.frombuffer(block["col"], np.int64)
        values = np.frombuffer(block["bands"]).reshape(len(bands), -1)
        held = dict(zip(bands, values))
        g = Ground(np.zeros(len(row), np.int64), row, col, held["sigma"], held.get("theta"), held.get("poids"), headings, anisotropy, turning, sigma_min, res)
        dist = np.frombuffer(block["dist"]).copy()
        before = dist.copy()
        at = g.place(np.zeros(len(labels), np.int64), labels.at_row.to_numpy(np.int64), labels.at_col.to_numpy(np.int64)) if len(labels) else np.zeros(0, np.int64)
        state, cost = (at * headings + labels["head"].to_numpy(np.int64))[at >= 0], labels["cost"].to_numpy(float)[at >= 0]
        lower = cost < dist[state]
        np.minimum.at(dist, state[lower], cost[lower])
        own = (row // tile == key[0]) & (col // tile == key[1])
        free = dist.reshape(-1, headings).min(axis=1, initial=np.inf) == 0
        g.correct(dist, np.unique(state[lower]), free, None, own)
        fallen = np.flatnonzero(dist < before)
        out = fallen[~own[fallen // headings]]
        rows = [block | {"dist": dist.tobytes()}]
        r, c = row[out // headings], col[out // headings]
        sent = pd.DataFrame({"tr": r // tile, "tc": c // tile, "kind": 1, "at_row": r, "at_col": c, "head": (out % headings).astype(np.int32), "cost": dist[out]})
        return pd.concat([pd.DataFrame(rows), sent], ignore_index=True).reindex(columns=names) if len(sent) else pd.DataFrame(rows)[names]

    tiles = materialize(placed.groupBy("tr", "tc").applyInPandas(build, schema))
    at = starts.filter("row is not null and col is not null").select("row", "col").distinct()
    first = at.select(F.floor(F.col("row") / tile).cast("long").alias("tr"), F.floor(F.col("col") / tile).cast("long").alias("tc"), F.col("row").cast("long").alias("at_row"),
                      F.col("col").cast("long").alias("at_col"), F.explode(F.array(*[F.lit(h) for h in range(headings)])).alias("head"), F.lit(0.0).alias("cost"))
    labels, made = materialize(first), None
    for _ in range(max_rounds):
        if labels.isEmpty():
            break
        asked = labels.select("tr", "tc").distinct()
        work = tiles.join(asked, ["tr", "tc"], "left_semi")
        done = work.groupBy("tr", "tc").cogroup(labels.groupBy("tr", "tc")).applyInPandas(search, schema)
        made = materialize(tiles.join(asked, ["tr", "tc"], "left_anti").unionByName(done))
        fresh = materialize(made.filter("kind = 1").select("tr", "tc", "at_row", "at_col", "head", "cost"))
        blocks = materialize(made.filter("kind = 0"))
        for gone in (labels, tiles, made):
            release(gone)
        labels, tiles = fresh, blocks
    else:
        raise RuntimeError(f"labels still fall after {max_rounds} rounds")
    release(labels)

    def unfold(frames):
        for pdf in frames:
            for tr, tc, row, col, dist in zip(pdf.tr, pdf.tc, pdf.row, pdf.col, pdf.dist):
                r, c = np.frombuffer(row, np.int64), np.frombuffer(col, np.int64)
                cost = np.frombuffer(dist).reshape(-1, headings).min(axis=1, initial=np.inf)
                mine = (r // tile == tr) & (c // tile == tc) & np.isfinite(cost)
                yield pd.DataFrame({"row": r[mine], "col": c[mine], "cost": cost[mine]})

    return tiles.select("tr", "tc", "row", "col", "dist").mapInPandas(unfold, "row long, col long, cost double")


def cell_of(x: float, y: float, grid: dict) -> tuple[int, int]:
    """Row and column of a point; off the grid is an error."""
    r, k = math.floor((grid["ymax"] - y) / grid["res"]), math.floor((x - grid["xmin"]) / grid["res"])
    if not (0 <= r < grid["nrow"] and 0 <= k < grid["ncol"]):
        raise ValueError(f"({x}, {y}) is off the grid")
    return r, k


def corridor_cells(cells: DataFrame, segments: DataFrame, reach: float, keys: list[str]) -> DataFrame:
    """Cells (``row, col, x, y, ...``) with the segments they are within ``reach`` of: one row for each pair, with the distance."""
    side = F.lit(float(reach))
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - side) / side).cast("long"), F.floor((F.greatest(a, b) + side) / side).cast("long"))
    cut = segment_pieces(segments.select(*keys, "x1", "y1", "x2", "y2"), 4 * reach)
    listed = cut.withColumn("__gx", F.explode(span(F.col("x1"), F.col("x2")))).withColumn("__gy", F.explode(span(F.col("y1"), F.col("y2"))))
    placed = cells.withColumn("__gx", F.floor(F.col("x") / side).cast("long")).withColumn("__gy", F.floor(F.col("y") / side).cast("long"))
    d = point_segment_distance("x", "y", "x1", "y1", "x2", "y2")
    # a list is many times what it is made from, so it must not be broadcast on that account
    near = placed.join(listed.hint("merge"), ["__gx", "__gy"]).withColumn("dist", d).filter(F.col("dist") <= reach)
    return near.groupBy(*keys, *cells.columns).agg(F.min("dist").alias("dist"))


def reposition(segments: DataFrame, cells: DataFrame, grid: dict, deviation: float = 10.0, attraction: float = 1.0, anisotropy: float = 4.0,
               turning: float = 2.0, sigma_min: float = 0.05, id_col: str = "id") -> DataFrame:
    """Re-route each line inside its corridor: ``geom``, ``DEPLACEMENT_MAX``, ``DEPLACEMENT_MOY``, ``RECALE``; rows are kept one for one.

    Lines are segments ``x1, y1, x2, y2``, or polylines with ``geom``, whose corridor
    follows all their bends. ``cells`` has ``row, col, x, y, sigma`` and may have ``theta, poids``.
    Conductivity is weakened away from the old axis and closed beyond
    ``deviation``; both ends stay. Lines that cannot be routed keep their geometry, and their displacement is null.
    """
    res = grid["res"]
    bands = [b for b in ("theta", "poids") if b in cells.columns]
    old = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    lines = segments if "geom" in segments.columns else segments.withColumn("geom", old)
    near = materialize(corridor_cells(cells.select("row", "col", "x", "y", "sigma", *bands), legs(lines, id_col), deviation, [id_col]).drop("x", "y"))
    # many lines are one group, by what their corridors hold
    deal = F.pmod(F.xxhash64(id_col), F.lit(near.count() // CORRIDOR + 1)).alias("__deal")
    axes = lines.select(id_col, F.col("geom").alias("__axis"), deal)
    schema = f"{id_col} long, geom array<struct<x:double,y:double>>, DEPLACEMENT_MAX double, DEPLACEMENT_MOY double, RECALE boolean"

    def route(key, pdf, axes):
        number = {i: k for k, i in enumerate(axes[id_col].tolist())}
        area = pdf[id_col].map(number).to_numpy(dtype=float)
        dist = pdf.dist.to_numpy()
        value = pdf.sigma.to_numpy(dtype=float) / (1 + attraction * (dist / deviation) ** 2)
        open_ = (dist <= max(deviation - math.sqrt(2) * res, res)) & ~np.isnan(value) & ~np.isnan(area)
        area, row, col = (v[open_].astype(np.int64) for v in (area, pdf.row.to_numpy(), pdf.col.to_numpy()))
        more = {b: pdf[b].to_numpy(dtype=float)[open_] for b in bands}
        ground = Ground(area, row, col, value[open_], more.get("theta"), more.get("poids"), 16, anisotropy, turning, sigma_min, res)
        old = [np.array([(float(q["x"]), float(q["y"])) for q in axis]).reshape(-1, 2) for axis in axes["__axis"]]
        ends = [np.array([axis[k] if len(axis) else (np.nan, np.nan) for axis in old]) for k in (0, -1)]
        places = []
        for xy in ends:
            r, c = np.floor((grid["ymax"] - xy[:, 1]) / res), np.floor((xy[:, 0] - grid["xmin"]) / res)
            inside = (r >= 0) & (r < grid["nrow"]) & (c >= 0) & (c < grid["ncol"])
            r, c = np.where(inside, r, 0).astype(np.int64), np.where(inside, c, 0).astype(np.int64)
            places.append(np.where(inside, ground.place(np.arange(len(old)), r, c), -1))
        out = []
        for i, axis, path in zip(axes[id_col].tolist(), old, sparse_paths(ground, *places)):
            if not path or len(path) < 2:
                continue
            xy = np.stack([grid["xmin"] + (ground.col[path] + 0.5) * res, grid["ymax"] - (ground.row[path] + 0.5) * res], axis=1)
            xy[0], xy[-1] = axis[0], axis[-1]
            moved = polyline_gaps(xy, axis)
            out.append({id_col: i, "geom": [{"x": x, "y": y} for x, y in xy.tolist()], "DEPLACEMENT_MAX": float(moved.max()), "DEPLACEMENT_MOY": float(moved.mean()), "RECALE": True})
        return pd.DataFrame(out, columns=[id_col, "geom", "DEPLACEMENT_MAX", "DEPLACEMENT_MOY", "RECALE"])

    done = near.select("*", deal).groupBy("__deal").cogroup(axes.groupBy("__deal")).applyInPandas(route, schema)
    joined = lines.join(done.withColumnRenamed("geom", "__geom"), id_col, "left")
    return joined.withColumn("geom", F.coalesce("__geom", "geom")).withColumn("RECALE", F.coalesce("RECALE", F.lit(False))).drop("__geom")


def polyline_gaps(points: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """Distance of each point to the polyline, some of its legs at a time."""
    best = np.full(len(points), np.inf)
    for k in range(0, max(len(axis) - 1, 0), 256):
        a, b = axis[k : k + 257][:-1], axis[k : k + 257][1:]
        d = b - a
        n = (d * d).sum(axis=1)
        t = ((points[:, None] - a) * d).sum(axis=2) / np.where(n > 0, n, 1)
        t = np.where(n > 0, np.clip(t, 0, 1), 0)
        best = np.minimum(best, np.hypot(*np.moveaxis(points[:, None] - a - t[:, :, None] * d, 2, 0)).min(axis=1))
    return best
