"""Rasters as blocks: a square of cells with a halo is one row of packed arrays.

What reads a raster around points asks the one block that its point lies in: points and blocks
are dealt by block, once, and sampled as arrays. A block with many points is dealt to several
groups. A raster that is read more than once is blocked once (``Blocks``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from timberline.session import materialize, release

SIDE = 128
#: Points of a block that one group reads, about.
POINTS = 20_000


@dataclass
class Blocks:
    """``rows``: ``br, bc`` and a packed array of ``side + 2 * halo`` cells squared for each band, NaN where there is no value."""

    rows: DataFrame
    grid: dict
    bands: list[str]
    side: int
    halo: int

    @classmethod
    def of(cls, cells: DataFrame, grid: dict, bands: list[str], side: int = SIDE, halo: int = 2) -> Blocks:
        """From cells ``row, col`` and bands; of a cell that comes more than once one row counts. A cell goes to each block whose halo holds it."""
        span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / side).cast("int"), F.floor((F.col(c) + halo) / side).cast("int")))
        placed = cells.filter("row is not null and col is not null").select("row", "col", *[F.col(b).cast("double").alias(b) for b in bands]).withColumn("br", span("row")).withColumn("bc", span("col"))
        wide = side + 2 * halo

        def pack(key, pdf):
            r0, c0 = int(key[0]) * side - halo, int(key[1]) * side - halo
            at = (pdf["row"].to_numpy(np.int64) - r0, pdf["col"].to_numpy(np.int64) - c0)
            out = {"br": int(key[0]), "bc": int(key[1])}
            for b in bands:
                a = np.full((wide, wide), np.nan)
                a[at] = pdf[b].to_numpy(float)
                out[b] = a.tobytes()
            return pd.DataFrame([out])

        rows = placed.groupBy("br", "bc").applyInPandas(pack, "br int, bc int, " + ", ".join(f"`{b}` binary" for b in bands))
        return cls(rows, grid, list(bands), side, halo)

    def place(self, x: str = "x", y: str = "y") -> list:
        """Block of a point as columns ``br`` and ``bc``."""
        res = self.grid["res"]
        return [F.floor(F.floor((self.grid["ymax"] - F.col(y)) / res) / self.side).cast("int").alias("__br"), F.floor(F.floor((F.col(x) - self.grid["xmin"]) / res) / self.side).cast("int").alias("__bc")]

    def read(self, points: DataFrame, reader, outputs: list[T.StructField], x: str = "x", y: str = "y") -> DataFrame:
        """``points`` with the columns that ``reader(table, {band: array}, row0, col0)`` makes of those that lie in one block.

        The array's first cell is ``(row0, col0)``; it is all NaN where the raster has no block.
        """
        wide, side, halo, bands = self.side + 2 * self.halo, self.side, self.halo, self.bands
        keyed = points.select("*", *self.place(x, y))
        # blocks in which many points lie are dealt to several groups
        crowded = materialize(keyed.groupBy("__br", "__bc").agg(F.count("*").alias("n")).filter(F.col("n") > POINTS).select("__br", "__bc", F.ceil(F.col("n") / POINTS).alias("deals")))
        blocks = self.rows.select(F.col("br").alias("__br"), F.col("bc").alias("__bc"), *[F.col(b).alias(f"__{k}") for k, b in enumerate(bands)])
        zero = F.lit(0).cast("long")
        if crowded.isEmpty():
            left, right = keyed.withColumn("__deal", zero), blocks.withColumn("__deal", zero)
        else:
            own = [n for n, kind in points.dtypes if not kind.startswith("map")]
            deals = crowded.select(*[F.col(c).alias(c) for c in crowded.columns])
            left = keyed.join(crowded, ["__br", "__bc"], "left").withColumn("__deal", F.coalesce(F.pmod(F.xxhash64(*own), F.col("deals")), zero)).drop("deals")
            right = blocks.join(deals, ["__br", "__bc"], "left").withColumn("__deal", F.explode(F.sequence(zero, F.coalesce(F.col("deals"), F.lit(1)) - 1))).drop("deals")
        keys = ["__br", "__bc", "__deal"]
        names, kinds = points.columns, [to_arrow_type(f.dataType) for f in outputs]

        def look(mine, block):
            arrays = {}
            r0 = c0 = 0
            if len(mine) and mine.column("__br")[0].is_valid and mine.column("__bc")[0].is_valid:
                r0, c0 = mine.column("__br")[0].as_py() * side - halo, mine.column("__bc")[0].as_py() * side - halo
            for k, b in enumerate(bands):
                arrays[b] = np.frombuffer(block.column(f"__{k}")[0].as_py()).reshape(wide, wide) if len(block) else np.full((wide, wide), np.nan)
            table = mine.select(names)
            made = list(reader(table, arrays, r0, c0)) if len(mine) else [pa.array([], k) for k in kinds]
            for field, values in zip(outputs, made):
                table = table.append_column(field.name, values)
            return table

        schema = T.StructType([*points.schema.fields, *outputs])
        return left.select(*keys, *names).groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(look, schema)

    def release(self) -> None:
        release(self.rows)


def bilinear(a: np.ndarray, fy: np.ndarray, fx: np.ndarray, row0: int = 0, col0: int = 0) -> np.ndarray:
    """Values between cell centres at fractional places of a raster whose cell ``(row0, col0)`` the array begins with; NaN where a cell that has weight is missing.

    Weights come from places in the whole raster, so that they are the same to the last bit whatever block is read.
    """
    r, c = np.floor(fy), np.floor(fx)
    ty, tx = fy - r, fx - c
    r, c = r.astype(np.int64) - row0, c.astype(np.int64) - col0
    n, m = a.shape
    out = np.zeros(fx.shape)
    for dr, dc, w in ((0, 0, (1 - tx) * (1 - ty)), (0, 1, tx * (1 - ty)), (1, 0, (1 - tx) * ty), (1, 1, tx * ty)):
        rr, cc = r + dr, c + dc
        inside = (rr >= 0) & (rr < n) & (cc >= 0) & (cc < m)
        v = np.where(inside, a[np.clip(rr, 0, n - 1), np.clip(cc, 0, m - 1)], np.nan)
        out += np.where(w > 0, w * v, 0.0)
    return out


def nearest(a: np.ndarray, fy: np.ndarray, fx: np.ndarray, row0: int = 0, col0: int = 0) -> np.ndarray:
    """Values of the cells that fractional places lie in, as ``bilinear`` counts them: centres are whole numbers."""
    r, c = np.floor(fy + 0.5).astype(np.int64) - row0, np.floor(fx + 0.5).astype(np.int64) - col0
    inside = (r >= 0) & (r < a.shape[0]) & (c >= 0) & (c < a.shape[1])
    return np.where(inside, a[np.clip(r, 0, a.shape[0] - 1), np.clip(c, 0, a.shape[1] - 1)], np.nan)


METHODS = {"bilinear": bilinear, "nearest": nearest}


def sample(blocks: Blocks, points: DataFrame, method: str = "bilinear", bands: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """``points`` (``x, y``, ...) with the value of each band; null where there is none. Rows with a null place get null."""
    bands, res, grid = bands or blocks.bands, blocks.grid["res"], blocks.grid
    how = METHODS[method]

    def reader(table, arrays, row0, col0):
        x, y = (table.column(c).to_numpy().astype(float) for c in "xy")
        fx, fy = (x - grid["xmin"]) / res - 0.5, (grid["ymax"] - y) / res - 0.5
        known = np.isfinite(fx) & np.isfinite(fy)
        for b in bands:
            v = how(arrays[b], np.where(known, fy, row0 - 9.0), np.where(known, fx, col0 - 9.0), row0, col0)
            yield pa.array(v, mask=np.isnan(v))

    return blocks.read(points, reader, [T.StructField(n, T.DoubleType()) for n in names or bands])


def profiles(blocks: Blocks, stations: DataFrame, band: str, half: float, step: float, method: str = "bilinear") -> DataFrame:
    """Stations (``x, y, nx, ny``) with ``z``: values across from left to right. One row goes through the exchange for each station, not for each value.

    The blocks' halo must reach ``half`` and two cells.
    """
    grid, res, n = blocks.grid, blocks.grid["res"], round(half / step)
    if blocks.halo < math.ceil(half / res) + 2:
        raise ValueError("the halo is narrower than the profiles")
    off = np.arange(-n, n + 1) * step
    how = METHODS[method]

    def reader(table, arrays, row0, col0):
        x, y, nx, ny = (table.column(c).to_numpy().astype(float)[:, None] for c in ("x", "y", "nx", "ny"))
        # the normal points left of the direction of travel
        fx, fy = (x - nx * off - grid["xmin"]) / res - 0.5, (grid["ymax"] - (y - ny * off)) / res - 0.5
        known = np.isfinite(fx) & np.isfinite(fy)
        v = how(arrays[band], np.where(known, fy, row0 - 9.0), np.where(known, fx, col0 - 9.0), row0, col0).ravel()
        yield pa.ListArray.from_arrays(np.arange(len(table) + 1, dtype=np.int32) * len(off), pa.array(v, mask=np.isnan(v)))

    return blocks.read(stations, reader, [T.StructField("z", T.ArrayType(T.DoubleType()))])
