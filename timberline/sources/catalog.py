"""Tile catalogue: names, products, LAS headers."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.functions.geometry import c

EXTENSIONS = {"laz": ("laz", "las"), "mnt": ("tif", "tiff"), "mnh": ("tif", "tiff")}


def tile_key(path) -> Column:
    """``0186_6834`` from the first pair of four-digit numbers between underscores in the file's name; null without."""
    base = F.element_at(F.split(c(path), "/"), -1)
    key = F.concat_ws("_", F.nullif(F.regexp_extract(base, r"_(\d{4})_(\d{4})_", 1), F.lit("")), F.nullif(F.regexp_extract(base, r"_(\d{4})_(\d{4})_", 2), F.lit("")))
    return F.nullif(key, F.lit(""))


def parse_tiles(files: DataFrame, path: str = "path", size: float = 1000.0) -> DataFrame:
    """Append ``cle, xmin, ymin, xmax, ymax``; the name gives the upper left corner in kilometres. Other names keep their row with nulls."""
    km = lambda k: F.element_at(F.split("cle", "_"), k).cast("double") * 1000
    keyed = files.withColumn("cle", tile_key(path))
    return keyed.withColumn("xmin", km(1)).withColumn("ymax", km(2)).withColumn("xmax", F.col("xmin") + size).withColumn("ymin", F.col("ymax") - size)


def catalog(files: DataFrame, headers: DataFrame | None = None, size: float = 1000.0) -> DataFrame:
    """One row a tile with the first path of each product; header extents win over names.

    ``files`` has ``path, type`` (laz, mnt, mnh). Names without a key are left out.
    """
    named = parse_tiles(files, size=size).filter(F.col("cle").isNotNull())
    wide = named.groupBy("cle", "xmin", "ymin", "xmax", "ymax").pivot("type", list(EXTENSIONS)).agg(F.min("path"))
    if headers is None:
        return wide
    h = headers.select(F.col("path").alias("laz"), *[F.col(k).alias(f"__{k}") for k in ("xmin", "ymin", "xmax", "ymax")], "annee", "logiciel")
    done = wide.join(h, "laz", "left")
    for k in ("xmin", "ymin", "xmax", "ymax"):
        done = done.withColumn(k, F.coalesce(f"__{k}", k)).drop(f"__{k}")
    return done


def list_files(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Paths of a product under a folder, from file metadata only."""
    frames = []
    for ext in EXTENSIONS[kind]:
        found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}").option("recursiveFileLookup", "true").load(folder)
        frames.append(found.select("path"))
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out.withColumn("type", F.lit(kind))


def las_header(content: bytes | None) -> dict | None:
    """Fields of an uncompressed LAS header (the layout is public); None if it is none."""
    if content is None or len(content) < 227 or content[:4] != b"LASF":
        return None
    day, year = struct.unpack_from("<HH", content, 90)
    xmax, xmin, ymax, ymin, zmax, zmin = struct.unpack_from("<6d", content, 179)
    major, minor = content[24], content[25]
    n = struct.unpack_from("<I", content, 107)[0]
    if (major, minor) >= (1, 4) and len(content) >= 255 and n == 0:
        n = struct.unpack_from("<Q", content, 247)[0]
    text = lambda a: content[a : a + 32].split(b"\0")[0].decode("latin-1").strip()
    return {"version": f"{major}.{minor}", "annee": year or None, "jour": day or None, "logiciel": text(58) or None, "n_points": n,
            "xmin": xmin, "ymin": ymin, "xmax": xmax, "ymax": ymax, "zmin": zmin, "zmax": zmax}


_HEADER = "path string, version string, annee int, jour int, logiciel string, n_points long, xmin double, ymin double, xmax double, ymax double, zmin double, zmax double"


def read_headers(files: DataFrame) -> DataFrame:
    """Header of each LAS file (``path, content``); unreadable ones keep a row of nulls."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in _HEADER.split(", "))])

    def run(batches):
        for batch in batches:
            rows = [{"path": p, **(las_header(b) or {})} for p, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content").mapInArrow(run, _HEADER)


def homogeneity(headers: DataFrame) -> DataFrame:
    """Distinct years and programs, and whether there are several of either."""
    got = headers.agg(F.count_distinct("annee").alias("n_annees"), F.count_distinct("logiciel").alias("n_logiciels"))
    return got.withColumn("heterogene", (F.col("n_annees") > 1) | (F.col("n_logiciels") > 1))


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__k", k).filter("__k = 1").drop("__k")
