"""Cell-wise operators: one row for each grid cell, bands as columns.

All are projections, but for the quantiles and maxima that a rule may leave
to the data; these are one aggregate, joined back as a single row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.geometry import c, point_segment_distance
from timberline.plans.ranks import quantiles
from timberline.session import materialize


@dataclass(frozen=True)
class Rule:
    """How one channel speaks for a road: ``up``, ``down`` or ``bell`` between ``a`` and ``b``; bounds left out come from the data."""

    kind: str
    weight: float = 1.0
    a: float | None = None
    b: float | None = None
    margin: float | None = None


#: Default rules of the two channels.
TERRAIN_RULES = {"vesselness": Rule("up", 2.0), "openness_neg": Rule("up", 1.0), "rugosite": Rule("up", 1.0)}
SURFACE_RULES = {"densite_sousetage": Rule("down", 2.0), "taux_penetration": Rule("down", 1.0)}
STATES = {1: "en_service", 2: "abandonnee", 3: "trouee_sans_route", 4: "hors_route"}
EPS = 2.220446049250313e-16


def clamp(v: Column, low: float, high: float) -> Column:
    """Null stays null (greatest and least alone would skip it)."""
    return F.when(v.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), v)))


def ramp(v, kind: str, a, b, margin=None) -> Column:
    """Membership from 0 to 1. ``b`` not above ``a`` counts as a hair above it; a null value has a null membership."""
    v, a, b = c(v), a if isinstance(a, Column) else F.lit(a), b if isinstance(b, Column) else F.lit(b)
    b = F.when(b <= a, a + EPS).otherwise(b)
    if kind == "up":
        return clamp((v - a) / (b - a), 0.0, 1.0)
    if kind == "down":
        return clamp((b - v) / (b - a), 0.0, 1.0)
    if kind == "bell":
        m = F.lit(margin) if margin is not None else (b - a) / 2
        return clamp(F.least((v - (a - m)) / m, ((b + m) - v) / m), 0.0, 1.0)
    raise ValueError(f"unknown kind of rule: {kind}")


def bounds(cells: DataFrame, band: str, kind: str, a: float | None = None, b: float | None = None) -> tuple[float | None, float | None]:
    """Given bounds, or exact quantiles of the band (.5 and .95; .25 and .75 for a bell)."""
    q = quantiles(cells, {band: [0.25, 0.75] if kind == "bell" else [0.5, 0.95]})[band]
    return (q[0] if a is None else a), (q[1] if b is None else b)


def membership(cells: DataFrame, band: str, kind: str = "up", a: float | None = None, b: float | None = None, out: str = "mu") -> DataFrame:
    """Append the membership of one band."""
    if a is None or b is None:
        a, b = bounds(cells, band, kind, a, b)
    return cells.withColumn(out, ramp(band, kind, a, b) if a is not None else F.lit(None).cast("double"))


def base_name(band: str) -> str:
    """Name of a band without the suffix of its scale."""
    return re.sub(r"_[0-9.]+$", "", band)


def matching(bands: list[str], rules: dict[str, Rule]) -> dict[str, list[str]]:
    """Bands of each rule, by base name. No match at all is an error."""
    found = {name: [b for b in bands if base_name(b) == name] for name in rules}
    found = {k: v for k, v in found.items() if v}
    if not found:
        raise ValueError(f"no band of {sorted(bands)} matches a rule of {sorted(rules)}")
    return found


def fuse(cells: DataFrame, rules: dict[str, Rule], sigma_min: float = 0.05, out: str = "sigma", bands: list[str] | None = None) -> DataFrame:
    """Weighted geometric mean of memberships: mean over the scales of a channel, floored at ``sigma_min``.

    A null at any scale makes the cell null. Bounds that the data must give
    are computed for all bands at once.
    """
    groups = matching(bands or cells.columns, rules)
    asked = {band: [0.25, 0.75] if rules[name].kind == "bell" else [0.5, 0.95] for name, bs in groups.items() for band in bs if rules[name].a is None or rules[name].b is None}
    found = quantiles(cells, asked) if asked else {}
    terms, total = [], 0.0
    for name, bs in groups.items():
        rule, mus = rules[name], []
        for band in bs:
            a = found[band][0] if rule.a is None else rule.a
            b = found[band][1] if rule.b is None else rule.b
            mus.append(ramp(band, rule.kind, F.lit(a).cast("double"), F.lit(b).cast("double"), rule.margin))
        mean = sum(mus[1:], mus[0]) / len(mus)
        terms.append(F.when(mean.isNotNull(), F.log(F.greatest(mean, F.lit(sigma_min)))) * rule.weight)
        total += rule.weight
    fused = F.exp(sum(terms[1:], terms[0]) / total)
    return cells.withColumn(out, fused)


def conductivity(cells: DataFrame, rules: dict[str, Rule] | None = None, sigma_min: float = 0.05, confidence: str | None = None, out: str = "sigma_geo") -> DataFrame:
    """Terrain conductivity, drawn towards one half where confidence is low."""
    done = fuse(cells, rules or TERRAIN_RULES, sigma_min, out)
    if confidence is None:
        return done
    k = clamp(F.col(confidence), 0.0, 1.0)
    return done.withColumn(out, k * F.col(out) + (1 - k) * 0.5)


def surface_conductivity(cells: DataFrame, rules: dict[str, Rule] | None = None, sigma_min: float = 0.05, excluded: str | None = None, out: str = "sigma_surf") -> DataFrame:
    """Surface conductivity; excluded cells take the floor."""
    done = fuse(cells, rules or SURFACE_RULES, sigma_min, out)
    if excluded is None:
        return done
    return done.withColumn(out, F.when(F.coalesce(F.col(excluded) > 0, F.lit(False)), F.lit(sigma_min)).otherwise(F.col(out)))


def saturation(cells: DataFrame, mu: str = "mu", share: float = 0.8) -> DataFrame:
    """Shares of cells at either end of a membership, and whether one end holds ``share`` or more."""
    low, high = F.avg((F.col(mu) <= 0).cast("double")), F.avg((F.col(mu) >= 1).cast("double"))
    return cells.filter(F.col(mu).isNotNull()).agg(low.alias("share_low"), high.alias("share_high")).withColumn(
        "saturated", F.greatest("share_low", "share_high") >= share
    )


def divergence(geo, surf) -> Column:
    return c(geo) - c(surf)


def state(geo, surf, geo_min: float = 0.5, surf_min: float = 0.5) -> Column:
    """1 to 4 from both conductivities; null where either is."""
    g, s = c(geo) >= geo_min, c(surf) >= surf_min
    return F.when(g & s, 1).when(g & ~s, 2).when(~g & s, 3).when(~g & ~s, 4)


def state_label(code) -> Column:
    out = None
    for k, name in STATES.items():
        out = F.when(c(code) == k, name) if out is None else out.when(c(code) == k, name)
    return out


def state_map(cells_geo: DataFrame, cells_surf: DataFrame, keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """Divergence and state of two aligned grids (an equi-join on the cell)."""
    both = cells_geo.join(cells_surf, list(keys))
    code = state("sigma_geo", "sigma_surf")
    return both.withColumn("divergence", divergence("sigma_geo", "sigma_surf")).withColumn("etat", code).withColumn("etat_label", state_label(F.col("etat")))


def resample_cubic(cells: DataFrame, source: dict, points: DataFrame, band: str, out: str | None = None) -> DataFrame:
    """Value by cubic convolution over four by four cells at each point; null where one that counts is missing or null."""
    res = source["res"]
    fx, fy = (F.col("x") - source["xmin"]) / res - 0.5, (source["ymax"] - F.col("y")) / res - 0.5
    keyed = points.withColumn("__id", F.monotonically_increasing_id()).withColumn("__fx", fx).withColumn("__fy", fy)

    def weights(t: Column) -> list[Column]:
        a = -0.5
        near = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
        away = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
        return [away(1 + t), near(t), near(1 - t), away(2 - t)]

    wx, wy = weights(F.col("__fx") - F.floor("__fx")), weights(F.col("__fy") - F.floor("__fy"))
    r0, c0 = F.floor("__fy").cast("int") - 1, F.floor("__fx").cast("int") - 1
    around = F.array(*[F.struct((r0 + i).alias("r"), (c0 + j).alias("c"), (wy[i] * wx[j]).alias("w")) for i in range(4) for j in range(4)])
    asked = keyed.select("*", F.explode(around).alias("__q")).filter("__q.w <> 0")
    src = cells.select(F.col("row").alias("__r"), F.col("col").alias("__c"), F.col(band).alias("__v"))
    got = asked.join(src, (F.col("__q.r") == F.col("__r")) & (F.col("__q.c") == F.col("__c")), "left")
    return got.groupBy("__id", *points.columns).agg(F.when(F.count("__v") == F.count("*"), F.sum(F.col("__q.w") * F.col("__v"))).alias(out or band)).drop("__id")


def resample_average(cells: DataFrame, source: dict, target: DataFrame, grid: dict, band: str) -> DataFrame:
    """Mean of the source cells over each cell of ``target`` (a table of cells of ``grid``), by the area they share; null values don't count."""
    res, side = source["res"], grid["res"]
    x0, y1 = source["xmin"] + F.col("col") * res, source["ymax"] - F.col("row") * res
    first = lambda v: F.floor(v / side + 1e-9).cast("int")
    last = lambda v: (F.ceil(v / side - 1e-9) - 1).cast("int")
    cut = cells.filter(F.col(band).isNotNull()).select("row", "col", F.col(band).alias("__v"), x0.alias("__x0"), y1.alias("__y1"))
    cut = cut.withColumn("__c", F.explode(F.sequence(first(F.col("__x0") - grid["xmin"]), last(F.col("__x0") + res - grid["xmin"]))))
    cut = cut.withColumn("__r", F.explode(F.sequence(first(grid["ymax"] - F.col("__y1")), last(grid["ymax"] - F.col("__y1") + res))))
    left, top = grid["xmin"] + F.col("__c") * side, grid["ymax"] - F.col("__r") * side
    wide = F.least(F.col("__x0") + res, left + side) - F.greatest(F.col("__x0"), left)
    high = F.least(F.col("__y1"), top) - F.greatest(F.col("__y1") - res, top - side)
    w = F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)
    mean = cut.withColumn("__w", w).filter("__w > 0").groupBy(F.col("__r").alias("row"), F.col("__c").alias("col")).agg((F.sum(F.col("__w") * F.col("__v")) / F.sum("__w")).alias(band))
    return target.join(mean, ["row", "col"], "left")


def inside(points: DataFrame, polygons: DataFrame, side: float = 1_000.0) -> DataFrame:
    """Distinct ``x, y`` of the points that lie in one of the polygons (``geom``: a ring of x, y, closed or not), by the even-odd rule.

    Points and polygons meet in squares of ``side`` that a polygon's bounds touch.
    """
    g, s = F.col("geom"), F.lit(float(side))
    bound = lambda f, c: f(F.transform(g, lambda v: v[c]))
    span = lambda c: F.explode(F.sequence(F.floor(bound(F.array_min, c) / s).cast("long"), F.floor(bound(F.array_max, c) / s).cast("long")))
    laid = polygons.filter(F.size(g) >= 3).select("geom").withColumn("__gx", span("x")).withColumn("__gy", span("y"))
    spots = points.select("x", "y").distinct().withColumn("__gx", F.floor(F.col("x") / s).cast("long")).withColumn("__gy", F.floor(F.col("y") / s).cast("long"))

    def crosses(k: Column) -> Column:
        a, b = F.element_at(g, k), F.element_at(g, k % F.size(g) + 1)
        straddles = (a["y"] > F.col("y")) != (b["y"] > F.col("y"))
        return F.when(straddles & (F.col("x") < (b["x"] - a["x"]) * (F.col("y") - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0)

    odd = F.aggregate(F.sequence(F.lit(1), F.size(g)), F.lit(0), lambda acc, k: acc + crosses(k)) % 2 == 1
    return spots.join(laid, ["__gx", "__gy"]).filter(odd).select("x", "y").distinct()


def detection_index(cells: DataFrame, weights: dict[str, float] | None = None, vessel_min: float = 0.3, reference: DataFrame | None = None,
                    reference_buffer: float = 15.0, out: str = "indice", extent: DataFrame | None = None) -> DataFrame:
    """Weighted geometric mean of conductivities and vesselness; cells near the known network, or outside the polygons of ``extent`` where given, are null.

    ``cells`` has ``x, y, sigma_geo, sigma_surf, vesselness``; ``reference``
    segments ``x1, y1, x2, y2``. Missing weights are zero; none above zero is
    an error. Segments are joined by grid squares of the buffer's size, not
    by all pairs.
    """
    w = {"geo": 1.0, "surf": 0.5, "vessel": 1.0} if weights is None else {k: weights.get(k, 0.0) for k in ("geo", "surf", "vessel")}
    total = sum(w.values())
    if total <= 0:
        raise ValueError("weights must have a positive sum")
    parts = {"geo": F.col("sigma_geo"), "surf": F.col("sigma_surf"), "vessel": ramp("vesselness", "up", vessel_min, 1.0)}
    logs = [F.when(v.isNotNull(), F.log(F.greatest(v, F.lit(1e-6)))) * w[k] for k, v in parts.items() if w[k] > 0]
    done = cells.withColumn(out, F.exp(sum(logs[1:], logs[0]) / total))
    if extent is not None:
        done = done.join(inside(cells, extent).withColumn("__in", F.lit(True)), ["x", "y"], "left").withColumn(out, F.when(F.col("__in"), F.col(out))).drop("__in")
    if reference is None:
        return done
    near = near_segments(cells.select("x", "y"), reference, reference_buffer).withColumn("__near", F.lit(True))
    joined = done.join(near, ["x", "y"], "left")
    return joined.withColumn(out, F.when(F.col("__near").isNull(), F.col(out))).drop("__near")


def near_segments(points: DataFrame, segments: DataFrame, reach: float) -> DataFrame:
    """Distinct points within ``reach`` of a segment, by an equi-join on squares of half that side.

    A square that lies within ``reach`` of one segment as a whole needs no segment to be looked at for its points. In
    the squares that no segment covers points meet the segments around, which are few wherever
    segments lie dense, so that neither the squares nor the pairs grow with the square of the table.
    Listed segments are never broadcast: a list is many times what it is made from.
    """
    side = reach / 2
    keyed = points.withColumn("__gx", F.floor(F.col("x") / side).cast("long")).withColumn("__gy", F.floor(F.col("y") / side).cast("long"))
    straight = segments.select(*[F.col(k).cast("double").alias(k) for k in ("x1", "y1", "x2", "y2")]).distinct()
    listed = squares_of(segment_pieces(spread(straight), 4 * reach), side, reach)
    # a rectangle around the segment, all of whose places are nearer than reach by half a square's diagonal
    inner = 0.7 * (reach * (1 - 1e-6) - side * 0.70711)
    whole = (F.abs("__across") <= inner) & F.col("__along").between(-inner, F.col("__len") + inner)
    seen = materialize(listed.groupBy("__gx", "__gy").agg(F.max(whole).alias("__whole")))
    open_ = seen.filter(~F.col("__whole")).select("__gx", "__gy")
    few = open_.count() <= SENT
    rest = listed.select("x1", "y1", "x2", "y2", "__gx", "__gy").join(F.broadcast(open_) if few else open_.hint("merge"), ["__gx", "__gy"], "left_semi")
    blank = [F.lit(None).cast("double").alias(k) for k in ("x1", "y1", "x2", "y2")]
    asked = seen.filter("__whole").select("__gx", "__gy", *blank).union(rest.select("__gx", "__gy", "x1", "y1", "x2", "y2"))
    hit = F.col("x1").isNull() | (point_segment_distance("x", "y", "x1", "y1", "x2", "y2") <= reach)
    return keyed.join(asked.hint("merge"), ["__gx", "__gy"]).filter(hit).select(*points.columns).distinct()


#: Squares that are sent to all tasks at most.
SENT = 150_000


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to as many tasks as a shuffle has, also where they are few: each is going to be many."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *rows.columns[:4])


def squares_of(pieces: DataFrame, side: float, reach: float) -> DataFrame:
    """Pieces of segments under each square ``__gx, __gy`` of a side that has a place within ``reach`` of them, and few others.

    With the piece's length and where the square's middle lies: ``__across`` its line, and ``__along`` it from the first end.
    """
    wide = reach * (1 + 1e-6)
    span = lambda a, b: F.explode(F.sequence(F.floor((F.least(a, b) - wide) / side).cast("long"), F.floor((F.greatest(a, b) + wide) / side).cast("long")))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    rows = pieces.withColumn("__len", F.sqrt(dx * dx + dy * dy))
    rows = rows.withColumn("__ux", F.when(F.col("__len") > 0, dx / F.col("__len")).otherwise(1.0)).withColumn("__uy", F.when(F.col("__len") > 0, dy / F.col("__len")).otherwise(0.0))
    rows = rows.withColumn("__gx", span(F.col("x1"), F.col("x2"))).withColumn("__gy", span(F.col("y1"), F.col("y2")))
    ex, ey = (F.col("__gx") + 0.5) * side - F.col("x1"), (F.col("__gy") + 0.5) * side - F.col("y1")
    rows = rows.withColumn("__across", ex * F.col("__uy") - ey * F.col("__ux")).withColumn("__along", ex * F.col("__ux") + ey * F.col("__uy"))
    return rows.filter(F.abs("__across") <= wide + side * 0.70711).drop("__ux", "__uy")


def segment_pieces(segments: DataFrame, length: float) -> DataFrame:
    """Cut segments into equal pieces no longer than ``length``; other columns are kept."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(dx * dx + dy * dy) / length)).cast("int")
    rest = [x for x in segments.columns if x not in ("x1", "y1", "x2", "y2")]
    cut = segments.withColumn("__n", n).withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    at = lambda p, q, k: F.when(F.col("__n") == k, F.col(q)).otherwise(F.col(p) + (F.col(q) - F.col(p)) * k / F.col("__n"))
    k = F.col("__k")
    return cut.select(*rest, at("x1", "x2", k).alias("x1"), at("y1", "y2", k).alias("y1"), at("x1", "x2", k + 1).alias("x2"), at("y1", "y2", k + 1).alias("y2"))


def ndvi(nir="pir", red="rouge") -> Column:
    """Null where both bands sum to zero."""
    return F.try_divide(c(nir) - c(red), c(nir) + c(red))


def reference_grid(xmin: float, ymin: float, xmax: float, ymax: float, res: float = 1.0) -> dict:
    """Extent snapped outward to multiples of the resolution."""
    import math

    x0, y0 = math.floor(xmin / res) * res, math.floor(ymin / res) * res
    x1, y1 = math.ceil(xmax / res) * res, math.ceil(ymax / res) * res
    return {"xmin": x0, "ymin": y0, "xmax": x1, "ymax": y1, "res": res, "nrow": round((y1 - y0) / res), "ncol": round((x1 - x0) / res)}


def grid_cells(spark, grid: dict) -> DataFrame:
    """All cells of a grid with their centres; rows count from the top."""
    n = grid["nrow"] * grid["ncol"]
    i, res = F.col("id"), grid["res"]
    return spark.range(n).select(
        F.floor(i / grid["ncol"]).cast("int").alias("row"), (i % grid["ncol"]).cast("int").alias("col")
    ).withColumn("x", grid["xmin"] + (F.col("col") + 0.5) * res).withColumn("y", grid["ymax"] - (F.col("row") + 0.5) * res)


def same_grid(a: dict, b: dict, tol: float = 1e-6) -> bool:
    return all(abs(a[k] - b[k]) <= tol for k in ("xmin", "ymin", "xmax", "ymax", "res"))


def resample_nearest(cells: DataFrame, source: dict, target: DataFrame, bands: list[str]) -> DataFrame:
    """Values of the source cell under each target centre; null outside."""
    at = target.withColumn("__c", F.floor((F.col("x") - source["xmin"]) / source["res"]).cast("int")).withColumn(
        "__r", F.floor((source["ymax"] - F.col("y")) / source["res"]).cast("int")
    )
    src = cells.select(F.col("row").alias("__r"), F.col("col").alias("__c"), *bands)
    return at.join(src, ["__r", "__c"], "left").drop("__r", "__c")


def resample_bilinear(cells: DataFrame, source: dict, points: DataFrame, band: str, out: str | None = None) -> DataFrame:
    """Bilinear value at each point; null where one of the four cells is missing or null.

    Points go once to the block of cells that they lie in, and are read there as arrays; they
    need not be distinct, and a null place gives null.
    """
    from timberline.operators import blocks

    return blocks.sample(blocks.Blocks.of(cells, source, [band]), points, "bilinear", [band], [out or band])
