"""Planar geometry as Column expressions. Lines are ``array<struct<x:double,y:double>>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def distance(x1, y1, x2, y2) -> Column:
    """Euclidean distance; the sum of squares is taken as it is, so that SQL twins agree to the last bit."""
    dx, dy = c(x2) - c(x1), c(y2) - c(y1)
    return F.sqrt(dx * dx + dy * dy)


def point_segment_distance(px, py, x1, y1, x2, y2) -> Column:
    """Distance of a point to a segment; to its first end where both ends coincide."""
    px, py, x1, y1, x2, y2 = map(c, (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / size))).otherwise(0.0)
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def segment_distance(x1, y1, x2, y2, u1, v1, u2, v2) -> Column:
    """Distance of two segments; zero where they cross."""
    ends = [(u1, v1, x1, y1, x2, y2), (u2, v2, x1, y1, x2, y2), (x1, y1, u1, v1, u2, v2), (x2, y2, u1, v1, u2, v2)]
    side = lambda ax, ay, bx, by, px, py: (c(bx) - c(ax)) * (c(py) - c(ay)) - (c(by) - c(ay)) * (c(px) - c(ax))
    apart = lambda a, b: ((a > 0) & (b < 0)) | ((a < 0) & (b > 0))
    cross = apart(side(x1, y1, x2, y2, u1, v1), side(x1, y1, x2, y2, u2, v2)) & apart(side(u1, v1, u2, v2, x1, y1), side(u1, v1, u2, v2, x2, y2))
    return F.when(cross, 0.0).otherwise(F.least(*[point_segment_distance(*e) for e in ends]))


def circumradius(x1, y1, x2, y2, x3, y3, flat: float = 1e-9) -> Column:
    """Radius of the circle through three points; infinite where their triangle has no area."""
    a, b, d = distance(x1, y1, x2, y2), distance(x2, y2, x3, y3), distance(x1, y1, x3, y3)
    x1, y1, x2, y2, x3, y3 = map(c, (x1, y1, x2, y2, x3, y3))
    area = F.abs((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) / 2
    return F.when(area > flat, a * b * d / (4 * area)).otherwise(float("inf"))


def heading(x1, y1, x2, y2) -> Column:
    """Direction of a segment in degrees, in [0, 180)."""
    return F.pmod(F.degrees(F.atan2(c(y2) - c(y1), c(x2) - c(x1))), F.lit(180.0))


def angle_gap(a, b) -> Column:
    """Gap of two undirected angles in degrees: 179 and 1 are two apart."""
    d = F.pmod(F.abs(c(a) - c(b)), F.lit(180.0))
    return F.least(d, 180.0 - d)


def undirected_gap(a, b) -> Column:
    """Gap of two line angles in radians, in [0, pi/2]."""
    d = F.pmod(F.abs(c(a) - c(b)), F.pi())
    return F.least(d, F.pi() - d)


def directed_gap(a, b) -> Column:
    """Gap of two headings in radians, in [0, pi]."""
    d = F.pmod(F.abs(c(a) - c(b)), 2 * F.pi())
    return F.least(d, 2 * F.pi() - d)


def line_length(geom) -> Column:
    g = c(geom)
    return F.aggregate(
        F.when(F.size(g) >= 2, F.sequence(F.lit(2), F.size(g))).otherwise(F.array().cast("array<int>")),
        F.lit(0.0),
        lambda acc, i: acc + F.sqrt(
            (F.element_at(g, i)["x"] - F.element_at(g, i - 1)["x"]) * (F.element_at(g, i)["x"] - F.element_at(g, i - 1)["x"])
            + (F.element_at(g, i)["y"] - F.element_at(g, i - 1)["y"]) * (F.element_at(g, i)["y"] - F.element_at(g, i - 1)["y"])
        ),
    )


def legs(lines: DataFrame, *keep: str, geom: str = "geom") -> DataFrame:
    """Straight pieces ``x1, y1, x2, y2`` of polylines (an array of x, y), one row each, with the columns of ``keep``."""
    g = F.col(geom)
    pairs = F.arrays_zip(F.slice(g, F.lit(1), F.size(g) - 1).alias("a"), F.slice(g, F.lit(2), F.size(g) - 1).alias("b"))
    rows = lines.filter(F.size(g) > 1).select(*keep, F.explode(pairs).alias("__s"))
    return rows.select(*keep, *[F.col(f"__s.{e}.{c}").alias(f"{c}{n}") for n, e in ((1, "a"), (2, "b")) for c in ("x", "y")])


def with_ends(lines: DataFrame, geom: str = "geom") -> DataFrame:
    """Polylines with their ends as ``x1, y1, x2, y2``; lines without ``geom`` have them already."""
    if geom not in lines.columns:
        return lines
    g = F.col(geom)
    return lines.withColumns({f"{c}{n}": F.element_at(g, k)[c] for n, k in ((1, 1), (2, -1)) for c in ("x", "y")})
