"""Map data by request: query text, verdicts on answers, retries, bisection, tags."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.geometry import c

HIGHWAYS = ("track", "path", "service", "unclassified", "tertiary", "residential")
MAX_DEPTH = 3


def request_text(values: tuple[str, ...], south: float, west: float, north: float, east: float, timeout: int = 90) -> str:
    """Query for ways of the given kinds inside a box (south, west, north, east)."""
    box = ",".join(f"{v:.6f}" for v in (south, west, north, east))
    return f'[out:xml][timeout:{timeout}];(way["highway"~"^({"|".join(values)})$"]({box}););(._;>;);out body;'


def verdict(status="status_code", content="content", error="error") -> Column:
    """What an answer is worth, in this order; a refusal is never an empty layer."""
    err, code, body = F.lower(c(error)), c(status), c(content)
    remark = F.lower(F.regexp_extract(body, "<remark>(.*?)</remark>", 1))
    return (
        F.when(err.isNotNull() & err.rlike("timeout|timed out"), "timeout")
        .when(err.isNotNull(), "reseau")
        .when(code.isNull(), "reseau")
        .when(code == 429, "quota")
        .when(code == 504, "timeout")
        .when((code < 200) | (code >= 300), "http")
        .when(F.coalesce(F.octet_length(body), F.lit(0)) < 100, "tronque")
        .when(body.contains("<remark>") & remark.rlike("quota|rate limit|too many"), "quota")
        .when(body.contains("<remark>") & remark.rlike("memory|timed out|timeout|too large"), "volume")
        .when(body.contains("<remark>"), "remark")
        .otherwise("ok")
    )


def retry_after(headers="headers") -> Column:
    """Seconds of a Retry-After header; null without."""
    return F.nullif(F.regexp_extract(c(headers), r"(?i)retry-after:\s*(\d+)", 1), F.lit("")).try_cast("int")


def tag_value(tags, key: str) -> Column:
    """Value of one key in ``"k"=>"v"`` text; null without."""
    return F.nullif(F.regexp_extract(c(tags), f'"{key}"=>"([^"]*)"', 1), F.lit(""))


def normalise(ways: DataFrame) -> DataFrame:
    """``(osm_id, highway, ...)``: the kind from its own column or from the other tags; both columns always there."""
    for k in ("osm_id", "highway", "other_tags"):
        if k not in ways.columns:
            ways = ways.withColumn(k, F.lit(None).cast("string"))
    return ways.withColumn("highway", F.coalesce("highway", tag_value("other_tags", "highway"))).drop("other_tags")


def distinct_ways(ways: DataFrame, order: list[str]) -> DataFrame:
    """One row for each id; rows without an id all stay."""
    k = F.row_number().over(Window.partitionBy("osm_id").orderBy(*order))
    named = ways.filter("osm_id is not null").withColumn("__k", k).filter("__k = 1").drop("__k")
    return named.union(ways.filter("osm_id is null"))


def quadrants(box: tuple[float, float, float, float]) -> list[tuple[float, float, float, float]]:
    """The four quarters of (xmin, ymin, xmax, ymax)."""
    x0, y0, x1, y1 = box
    xm, ym = (x0 + x1) / 2, (y0 + y1) / 2
    return [(x0, y0, xm, ym), (xm, y0, x1, ym), (x0, ym, xm, y1), (xm, ym, x1, y1)]


@dataclass
class Refused(Exception):
    """Why an area could not be had."""

    status: str
    box: tuple


@dataclass
class Answer:
    status: str
    rows: list | None = None
    wait: float | None = None


def ask(transport: Callable[[str, tuple], Answer], servers: list[str], box: tuple, retries: int = 2, sleep: Callable[[float], None] = time.sleep, patience: float = 10.0) -> Answer:
    """Ask the servers in turn; wait only for a quota that ends soon."""
    last = Answer("reseau")
    for _ in range(retries + 1):
        for server in servers:
            last = transport(server, box)
            if last.status in ("ok", "volume"):
                return last
        if last.status == "quota" and last.wait is not None and last.wait <= patience:
            sleep(last.wait)
        elif last.status == "quota":
            return last
    return last


def harvest(fetch: Callable[[tuple], Answer], box: tuple, side_min: float | None = None, depth: int = 0) -> list:
    """Rows of a box; only an area that is too much is quartered, three times at most. Other refusals raise."""
    got = fetch(box)
    if got.status == "ok":
        return got.rows or []
    fits = side_min is None or min(box[2] - box[0], box[3] - box[1]) / 2 >= side_min
    if got.status in ("volume", "timeout") and depth < MAX_DEPTH and fits:
        return [row for part in quadrants(box) for row in harvest(fetch, part, side_min, depth + 1)]
    raise Refused(got.status, box)


def image_tiles(spark, box: tuple, step: float = 200.0) -> DataFrame:
    """Requests that cover a box with squares of ``step``: one row each, for a fetcher in ``mapInPandas``."""
    import math

    x0, y0, x1, y1 = box
    nx, ny = math.ceil((x1 - x0) / step), math.ceil((y1 - y0) / step)
    i = F.col("id")
    return spark.range(nx * ny).select(
        (x0 + (i % nx) * step).alias("xmin"), (y0 + F.floor(i / nx) * step).alias("ymin"),
        F.least(x0 + (i % nx + 1) * step, F.lit(x1)).alias("xmax"), F.least(y0 + (F.floor(i / nx) + 1) * step, F.lit(y1)).alias("ymax"),
    )


def extent(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Bounding box, one row."""
    return df.agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))
