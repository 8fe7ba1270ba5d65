"""Lines from a mask of cells: skeleton graph, and straight fits of patches.

A mask may hang together over any extent, so nothing here holds a patch. Tiles are thinned and pruned with a
halo as wide as what one exchange can change, and exchanged until nothing changes: the result is that of the whole mask.
Each tile then traces the runs of its own cells; runs that go on in another tile are
joined by the step that crosses the border, and one line's pieces are a group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.geometry import line_length
from timberline.operators.stencils import thin
from timberline.plans.components import connected_components
from timberline.session import materialize, release

TILE = 256
#: Rounds of deletions that a tile makes before it looks at its neighbours again.
THINNED = 8
#: Cells along a border that one window numbers.
STRETCH = 4_096

_AROUND = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]


def patches(cells: DataFrame, ncol: int) -> DataFrame:
    """Cells (``row, col``) with ``patch``: their eight-connected component, named by the smallest cell number."""
    own = cells.select("row", "col", (F.col("row").cast("long") * ncol + F.col("col")).alias("cell"))
    own = materialize(own)
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    near = own.select("cell", "row", "col", step.alias("s")).select(F.col("cell").alias("src"), (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"))
    edges = near.join(own, ["row", "col"]).select("src", F.col("cell").alias("dst"))
    parts = connected_components(edges)
    return own.join(parts, F.col("cell") == F.col("node"), "left").select("row", "col", "cell", F.coalesce("component", "cell").alias("patch"))


def around(cells: set, c: tuple[int, int]) -> list[tuple[int, int]]:
    """Cells that ``c`` is linked with; a diagonal step that two side steps already make is no link of its own."""
    n = [(c[0] + a, c[1] + b) for a, b in _AROUND if (c[0] + a, c[1] + b) in cells]
    side = {x for x in n if x[0] == c[0] or x[1] == c[1]}
    return [x for x in n if x in side or not (((x[0], c[1]) in side) or ((c[0], x[1]) in side))]


def chains(mask: np.ndarray, prune: int = 5) -> list[np.ndarray]:
    """Chains of a thin mask as arrays of (row, col): between cells that have other than two neighbours, then closed loops. Short spurs are pruned.

    The plain way, over a whole mask in memory; ``skeleton_lines`` gives the same lines by tiles.
    """
    cells = {tuple(c) for c in np.argwhere(mask).tolist()}

    while True:
        links = {c: around(cells, c) for c in cells}
        nodes = {c for c, n in links.items() if len(n) != 2}
        out, used = [], set()
        for start in sorted(nodes):
            for nxt in links[start]:
                if (start, nxt) in used:
                    continue
                path, before, at = [start, nxt], start, nxt
                used |= {(start, nxt)}
                while at not in nodes:
                    go = [x for x in links[at] if x != before]
                    if not go:
                        break
                    before, at = at, go[0]
                    path.append(at)
                used |= {(path[-1], path[-2])}
                out.append(path)
        free = cells - {c for p in out for c in p} - nodes
        while free:
            start = min(free)
            path, before, at = [start], None, start
            while True:
                free.discard(at)
                go = [x for x in links[at] if x != before and (x in free or (x == start and len(path) > 2))]
                if not go:
                    break
                before, at = at, go[0]
                path.append(at)
                if at == start:
                    break
            if len(path) > 1:
                out.append(path)
        spur = [p for p in out if len(p) - 1 < prune and (len(links[p[0]]) == 1) != (len(links[p[-1]]) == 1)]
        if not spur:
            return [np.array(p) for p in out]
        for p in spur:
            cells -= set(p[:-1] if len(links[p[0]]) == 1 else p[1:])


def by_tiles(cells: DataFrame, halo: int, tile: int) -> DataFrame:
    """Cells (``row, col``) with the tiles ``tr, tc`` whose halo holds them, one row for each."""
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / tile).cast("long"), F.floor((F.col(c) + halo) / tile).cast("long")))
    return cells.select("row", "col").withColumn("tr", span("row")).withColumn("tc", span("col"))


def _own(cells, key, tile: int):
    return [c for c in cells if c[0] // tile == key[0] and c[1] // tile == key[1]]


def _until_settled(cells: DataFrame, halo: int, tile: int, survivors) -> DataFrame:
    """Rounds of ``survivors(set or mask of a tile with its halo)`` until no cell goes; written tables in between."""

    def run(key, pdf):
        left = _own(survivors(pdf[["row", "col"]].to_numpy(np.int64)), [int(k) for k in key], tile)
        return pd.DataFrame(left, columns=["row", "col"]).astype(np.int64)

    held = materialize(cells.filter("row is not null and col is not null").select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).distinct())
    n = held.count()
    while n:
        left = materialize(by_tiles(held, halo, tile).groupBy("tr", "tc").applyInPandas(run, "row long, col long"))
        before, n = n, left.count()
        release(held)
        held = left
        if n == before:
            break
    return held


def thinned(cells: DataFrame, tile: int = TILE, rounds: int = THINNED) -> DataFrame:
    """The cells (``row, col``) that ``thin`` leaves of the whole mask; written out. Repeated cells and null places count for nothing."""

    def survivors(at: np.ndarray) -> list:
        low = at.min(axis=0)
        mask = np.zeros(at.max(axis=0) - low + 1, bool)
        mask[tuple((at - low).T)] = True
        return (np.argwhere(thin(mask, rounds)) + low).tolist()

    # what is missing beyond the halo reaches one cell further with each of two deletions a round
    return _until_settled(cells, 2 * rounds, tile, survivors)


def pruned(cells: DataFrame, prune: int, tile: int = TILE) -> DataFrame:
    """A thin mask without its spurs: chains of fewer than ``prune`` steps with one free end; written out."""

    def survivors(at: np.ndarray) -> set:
        held = set(map(tuple, at.tolist()))
        links = {}

        def of(c):
            if c not in links:
                links[c] = around(held, c)
            return links[c]

        gone = set()
        for c in held:
            if len(of(c)) != 1:
                continue
            path, end = [c], of(c)[0]
            while len(of(end)) == 2 and len(path) < prune:
                path.append(end)
                end = next(x for x in of(end) if x != path[-2])
            if len(path) < prune and len(of(end)) > 2:
                gone.update(path)
        return held - gone

    # a spur that begins in the halo may end here, and its cells' neighbours must be known
    return _until_settled(cells, 2 * prune + 2, tile, survivors)


def _pieces(cells: set, own: list) -> list[tuple[list, list, bool]]:
    """Runs of a tile's own cells as ``(path, crossings, whole)``: crossings are steps between this run and one of another tile."""
    mine, out = set(own), []
    links = {c: around(cells, c) for c in cells}
    node = {c for c in cells if len(links[c]) != 2}
    done = set()
    for c in sorted(mine):
        if c in node:
            out += [([c, x], [], True) for x in links[c] if x in node and c < x]
            continue
        if c in done:
            continue
        path, crossings, ring = [c], [], False
        done.add(c)
        for way in (0, 1):
            at, nxt = c, links[c][way]
            found = []
            while True:
                if nxt in node:
                    found.append(nxt)
                    break
                if nxt not in mine:
                    crossings.append((min(at, nxt), max(at, nxt)))
                    break
                if nxt in done:
                    ring = True
                    break
                done.add(nxt)
                found.append(nxt)
                before, at = at, nxt
                nxt = next(x for x in links[at] if x != before)
            path = path + found if way == 0 else found[::-1] + path
            if ring:
                path.append(c)
                break
        out.append((path, crossings, not crossings))
    return out


def _in_order(path: list, ring: bool) -> list:
    """A line in the direction that does not depend on tiles; a ring begins at its least cell."""
    if ring:
        k = path.index(min(path))
        path = path[k:-1] + path[:k] + [path[k]]
    a, b = (path[0], path[-1]) if path[0] != path[-1] else (path[1], path[-2])
    return path if a <= b else path[::-1]


def _joined(pieces: list[list], crossings: list[list]) -> tuple[list, bool]:
    """One line from its pieces, and whether it is a ring."""
    by: dict[tuple, list[int]] = {}
    for k, mine in enumerate(crossings):
        for x in mine:
            by.setdefault(x, []).append(k)
    start = next((k for k, mine in enumerate(crossings) if len(mine) == 1), None)
    ring = start is None
    at, came, path, used = 0 if ring else start, None, [], set()
    while at is not None and at not in used:
        used.add(at)
        piece = pieces[at]
        # the end of a piece that a step belongs to is the cell it shares with it
        go = next((x for x in crossings[at] if x != came), None)
        if came is not None:
            piece = piece if piece[0] in came else piece[::-1]
        elif go is not None:
            piece = piece if piece[-1] in go else piece[::-1]
        path += piece
        at, came = (None if go is None else next((k for k in by[go] if k != at), None)), go
    return (path + [path[0]] if ring else path), ring


def skeleton_lines(cells: DataFrame, grid: dict, prune: int = 5, length_min: float = 0.0, tile: int = TILE) -> DataFrame:
    """Lines ``(id, geom)`` of the skeleton of a mask given by its cells.

    The same for any size of tile. A line is named by the least of its inner cells, one between two neighbouring nodes by the
    lesser of them and the direction.
    """
    res, wide = grid["res"], grid["ncol"]
    thin_cells = thinned(cells, tile)
    kept = pruned(thin_cells, prune, tile) if prune > 0 else thin_cells
    schema = "piece long, whole boolean, ring boolean, path array<struct<row:long,col:long>>, crossings array<struct<a:long,b:long>>"
    number = lambda c: c[0] * wide + c[1]

    def name(path: list) -> int:
        if len(path) == 2:
            a, b = sorted(path)
            return (number(a) * 4 + (b[0] - a[0]) * (b[1] - a[1] + 2)) * 2 + 1
        return min(map(number, path[:-1] if path[0] == path[-1] and len(path) > 3 and path[0] == min(path) else path[1:-1])) * 8

    def trace(key, pdf):
        held = set(map(tuple, pdf[["row", "col"]].to_numpy(np.int64).tolist()))
        rows = []
        for path, crossings, whole in _pieces(held, _own(held, [int(k) for k in key], tile)):
            ring = whole and len(path) > 3 and path[0] == path[-1] and len(around(held, path[0])) == 2
            rows.append({"piece": number(min(path[1:-1] or path)) if not whole else name(_in_order(path, ring)), "whole": whole, "ring": ring,
                         "path": [{"row": r, "col": c} for r, c in (_in_order(path, ring) if whole else path)], "crossings": [{"a": number(a), "b": number(b)} for a, b in crossings]})
        return pd.DataFrame(rows, columns=["piece", "whole", "ring", "path", "crossings"])

    pieces = materialize(by_tiles(kept, 2, tile).groupBy("tr", "tc").applyInPandas(trace, schema))
    for done in (thin_cells, kept):
        release(done)
    open_ = pieces.filter("not whole").withColumn("piece", F.monotonically_increasing_id())
    open_ = materialize(open_.select("piece", "path", "crossings"))
    crossed = open_.select("piece", F.explode("crossings").alias("x")).groupBy("x").agg(F.min("piece").alias("src"), F.max("piece").alias("dst"))
    parts = materialize(connected_components(crossed))

    def join(key, pdf):
        ways = [[(p["row"], p["col"]) for p in path] for path in pdf["path"]]
        steps = [[((x["a"] // wide, x["a"] % wide), (x["b"] // wide, x["b"] % wide)) for x in mine] for mine in pdf["crossings"]]
        path = _in_order(*_joined(ways, steps))
        return pd.DataFrame([{"id": name(path), "path": [{"row": r, "col": c} for r, c in path]}])

    long = open_.join(parts, F.col("piece") == F.col("node")).groupBy("component").applyInPandas(join, "id long, path array<struct<row:long,col:long>>")
    lines = pieces.filter("whole").select(F.col("piece").alias("id"), "path").unionByName(long)
    geom = F.transform("path", lambda c: F.struct((F.lit(grid["xmin"]) + (c["col"] + 0.5) * res).alias("x"), (F.lit(grid["ymax"]) - (c["row"] + 0.5) * res).alias("y")))
    out = lines.select("id", geom.alias("geom"))
    return out.filter(line_length("geom") >= length_min) if length_min > 0 else out


def straight_lines(cells: DataFrame, grid: dict, length_min: float = 30.0, ratio_min: float = 3.0, bin_step: float = 5.0) -> DataFrame:
    """One line for each elongated patch: bins along its main axis, mean along and median across. All aggregates."""
    res = grid["res"]
    least = max(5, math.ceil(length_min / res))
    p = patches(cells, grid["ncol"]).withColumn("x", grid["xmin"] + (F.col("col") + 0.5) * res).withColumn("y", grid["ymax"] - (F.col("row") + 0.5) * res)
    facts = p.groupBy("patch").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("vxy")).filter(F.col("n") >= least)
    d = F.sqrt((F.col("vx") - F.col("vy")) * (F.col("vx") - F.col("vy")) / 4 + F.col("vxy") * F.col("vxy"))
    l1, l2 = (F.col("vx") + F.col("vy")) / 2 + d, (F.col("vx") + F.col("vy")) / 2 - d
    axis = F.atan2(2 * F.col("vxy"), F.col("vx") - F.col("vy")) / 2
    facts = facts.withColumn("ratio", F.when(l2 > 1e-12, F.sqrt(l1 / l2)).otherwise(float("inf"))).withColumn("a", axis).filter(F.col("ratio") >= ratio_min)
    q = p.join(materialize(facts), "patch")
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    q = q.withColumn("u", dx * F.cos("a") + dy * F.sin("a")).withColumn("v", dy * F.cos("a") - dx * F.sin("a"))
    bins = q.groupBy("patch", "mx", "my", "a", F.floor(F.col("u") / bin_step).alias("b")).agg(F.avg("u").alias("u"), F.median("v").alias("v"))
    pts = bins.select("patch", "b", (F.col("mx") + F.col("u") * F.cos("a") - F.col("v") * F.sin("a")).alias("x"), (F.col("my") + F.col("u") * F.sin("a") + F.col("v") * F.cos("a")).alias("y"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("b", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    return pts.groupBy("patch").agg(line.alias("geom"), F.count("*").alias("n")).filter("n >= 2").select(F.col("patch").alias("id"), "geom")


def border_runs(cells: DataFrame, grid: dict, level: float, band: str = "p", inside: int = 2) -> DataFrame:
    """Runs of strong cells along each border, ``inside`` cells within: their middle and the heading inward. Gaps and islands."""
    n, m, res = grid["nrow"], grid["ncol"], grid["res"]
    sides = [("bas", F.col("row") == n - 1 - inside, "col", (0.0, 1.0)), ("haut", F.col("row") == inside, "col", (0.0, -1.0)),
             ("ouest", F.col("col") == inside, "row", (1.0, 0.0)), ("est", F.col("col") == m - 1 - inside, "row", (-1.0, 0.0))]
    out = None
    for name, on, along, (hx, hy) in sides:
        k = F.col(along)
        w = Window.partitionBy("s").orderBy(along)  # a stretch of a border
        strong = cells.filter(on & (F.col(band) >= level)).withColumn("s", F.floor(k / STRETCH)).withColumn("g", k - F.row_number().over(w))
        runs = strong.groupBy("s", "g").agg(F.min(k).alias("a"), F.max(k).alias("b"), F.min("row").alias("r"), F.min("col").alias("c"))
        if (m if along == "col" else n) > STRETCH:
            # runs that go on in the next stretch
            runs = materialize(runs)
            parts = connected_components(runs.alias("l").join(runs.alias("r"), F.col("r.a") == F.col("l.b") + 1).select(F.col("l.a").alias("src"), F.col("r.a").alias("dst")))
            named = runs.join(parts, F.col("a") == F.col("node"), "left").withColumn("g", F.coalesce("component", "a"))
            runs = named.groupBy("g").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("r").alias("r"), F.min("c").alias("c"))
        mid = runs.withColumn("k", F.floor((F.col("a") + F.col("b") + 1) / 2))
        row, col = (F.col("r"), F.col("k")) if along == "col" else (F.col("k"), F.col("c"))
        got = mid.select(F.lit(name).alias("cote"), (grid["xmin"] + (col + 0.5) * res).alias("x"), (grid["ymax"] - (row + 0.5) * res).alias("y"), F.lit(hx).alias("hx"), F.lit(hy).alias("hy"))
        out = got if out is None else out.union(got)
    return out
