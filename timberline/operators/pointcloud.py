"""Point-cloud metrics by cell: one hash aggregate over points ``(x, y, z, h, cls)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXCLUDED = (6, 9, 64, 66)


def to_cells(points: DataFrame, grid: dict) -> DataFrame:
    """Row and column of each point; points beyond the grid go."""
    res = grid["res"]
    row, col = F.floor((grid["ymax"] - F.col("y")) / res).cast("int"), F.floor((F.col("x") - grid["xmin"]) / res).cast("int")
    return points.withColumn("row", row).withColumn("col", col).filter(
        (F.col("row") >= 0) & (F.col("row") < grid["nrow"]) & (F.col("col") >= 0) & (F.col("col") < grid["ncol"])
    )


def point_layers(points: DataFrame, res: float = 1.0, understorey: tuple[float, float] = (0.3, 3.0), ground: int = 2, canopy: int = 5, bridge: int = 17,
                 excluded: tuple[int, ...] = EXCLUDED, quantile: float = 0.95) -> DataFrame:
    """Per cell: ground density, penetration, understorey density, canopy height, masks.

    The canopy height is the exact interpolated quantile of canopy points.
    Counts are zero only in cells that have points.
    """
    n = F.count("*")
    cls, h = F.col("cls"), F.col("h")
    is_ground = F.count_if(cls == ground)
    return points.groupBy("row", "col").agg(
        n.alias("n_points"),
        (is_ground / (res * res)).alias("densite_sol"),
        (is_ground / n).alias("taux_penetration"),
        F.count_if((h >= understorey[0]) & (h < understorey[1])).cast("double").alias("densite_sousetage"),
        F.percentile(F.when(cls == canopy, h), F.lit(quantile)).alias("hauteur_couvert"),
        (F.count_if(cls.isin(*excluded)) > 0).cast("int").alias("masque_exclusion"),
        (F.count_if(cls == bridge) > 0).cast("int").alias("masque_pont"),
    )


def normalised(points: DataFrame, cells: DataFrame, grid: dict) -> DataFrame:
    """Height above the ground cell under each point; null without ground. Stands for a triangulated ground."""
    ground = cells.select("row", "col", F.col("z").alias("__ground"))
    return to_cells(points, grid).join(ground, ["row", "col"], "left").withColumn("h", F.col("z") - F.col("__ground")).drop("__ground", "row", "col")


def clearance_cells(points: DataFrame, low: float = 0.3) -> DataFrame:
    """Least height of echoes above ``low`` in each cell."""
    return points.filter(F.col("h") > low).groupBy("row", "col").agg(F.min("h").alias("h_min"))


def free_clearance(stations_cells: DataFrame, clear: DataFrame, ceiling: float = 8.0, keys: tuple[str, ...] = ("trace_id", "station")) -> DataFrame:
    """``GABARIT_LIBRE``: least clearance over the cells of each station's profile; the ceiling where nothing hangs lower."""
    got = stations_cells.join(clear, ["row", "col"], "left").groupBy(*keys).agg(F.min("h_min").alias("__h"))
    return got.select(*keys, F.least(F.coalesce(F.col("__h"), F.lit(ceiling)), F.lit(ceiling)).alias("GABARIT_LIBRE"))
