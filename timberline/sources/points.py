"""Point clouds as Parquet: reading by rectangle and by corridor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators.cells import near_segments


def require_paths(paths: list[str]) -> list[str]:
    """At least one path, each named; a hint at what is missing otherwise."""
    missing = [k for k, p in enumerate(paths) if not p]
    if not paths or missing:
        raise ValueError("at least one path is needed" if not paths else f"paths {missing} are empty")
    return paths


def read_points(spark: SparkSession, paths: list[str], box: tuple[float, float, float, float] | None = None, tiles: list[str] | None = None) -> DataFrame:
    """Points of Parquet tables; a rectangle is a pair of ranges that Parquet's statistics can skip by, tiles prune partitions."""
    points = spark.read.parquet(*require_paths(paths))
    if tiles is not None:
        points = points.filter(F.col("tile_key").isin(*tiles))
    if box is not None:
        x0, y0, x1, y1 = box
        points = points.filter((F.col("x") >= x0) & (F.col("x") <= x1) & (F.col("y") >= y0) & (F.col("y") <= y1))
    return points


def curve_key(x: Column, y: Column, res: float = 1.0) -> Column:
    """Place of a point's square on the Z-order curve: bits of its column and row, in turn. Squares up to 2^30 from the origin."""

    def spread(v):
        v = (F.floor(v / res).cast("long") + (1 << 30)).bitwiseAND(F.lit((1 << 31) - 1).cast("long"))
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def write_by_curve(points: DataFrame, path: str, res: float = 1.0, files: int | None = None, group_bytes: int = 32 << 20) -> None:
    """Points laid out along the Z-order curve, so that a file and each of its row groups hold a compact piece of land and a rectangle skips the rest.

    Ranges of the curve are cut by a sample of the points, so that files are even also where points cluster. Points with a null place come first.
    """
    keyed = points.withColumn("__z", curve_key(F.col("x"), F.col("y"), res))
    ranged = keyed.repartitionByRange(files, "__z", F.xxhash64("x", "y")) if files else keyed.repartitionByRange("__z", F.xxhash64("x", "y"))
    ranged.sortWithinPartitions("__z").drop("__z").write.option("parquet.block.size", group_bytes).parquet(path)


def in_corridor(points: DataFrame, segments: DataFrame, buffer: float = 40.0) -> DataFrame:
    """Points within ``buffer`` of a segment: squares first, then the exact distance."""
    spots = near_segments(points.select("x", "y").distinct(), segments, buffer)
    return points.join(spots, ["x", "y"], "left_semi")
