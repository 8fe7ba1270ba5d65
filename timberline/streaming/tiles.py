"""Point tiles that arrive over time: the cell aggregate of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators.pointcloud import point_layers


def arriving_points(spark: SparkSession, folder: str, schema: str = "tile_key string, row int, col int, h double, cls int", per_trigger: int = 100) -> DataFrame:
    """Stream of Parquet point files as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def count_cells(points: DataFrame, ground: int = 2) -> DataFrame:
    """Running counts by tile and cell; combine states by sums, so late files only add."""
    return points.groupBy("tile_key", "row", "col").agg(F.count("*").alias("n_points"), F.count_if(F.col("cls") == ground).alias("n_sol"), F.min("h").alias("h_min"))


def layers_of_batch(target: str):
    """A ``foreachBatch`` sink: whole tiles of a batch become layers, one folder for each batch, so a retry overwrites itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        point_layers(batch).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return write
