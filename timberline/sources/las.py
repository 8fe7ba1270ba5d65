"""LAS points and headers by byte ranges, as Spark data sources; a sink that writes LAS files.

A header costs its first 375 bytes, whatever the file holds. Points are read by parts of a file: each task
turns its byte range into a range of records, which are of fixed length, and files whose header's
rectangle lies outside the asked one are not read further. Point formats 0 to 10, not compressed.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from timberline.sources.catalog import _HEADER, las_header
from timberline.sources.ranges import PUSH, Box, Part, Pushed, Ranges, options, parts

HEADER_BYTES = 375
#: Records decoded at once.
RECORDS = 65_536
#: Points that a task writes into one file, about.
FILE = 1_000_000
SCHEMA = ("path string, x double, y double, z double, intensity int, return_number int, returns int, classification int, angle double, "
          "user_data int, source int, gps_time double, red int, green int, blue int, nir int")
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
_ARROW = pa.schema([(n, _KINDS[k]) for n, k in (f.split() for f in SCHEMA.split(", "))])
_HEADER_ARROW = pa.schema([(n, _KINDS[k]) for n, k in (f.split() for f in _HEADER.split(", "))])

# The layout of point records in the public format.
_OLD = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("cls", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")]
_NEW = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("cls", "u1"), ("user", "u1"), ("angle", "<i2"), ("source", "<u2"), ("gps", "<f8")]
_GPS, _COLOUR, _NIR, _WAVE = [("gps", "<f8")], [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")], [("nir", "<u2")], [("wave", "V29")]
FORMATS = {0: _OLD, 1: _OLD + _GPS, 2: _OLD + _COLOUR, 3: _OLD + _GPS + _COLOUR, 4: _OLD + _GPS + _WAVE, 5: _OLD + _GPS + _COLOUR + _WAVE,
           6: _NEW, 7: _NEW + _COLOUR, 8: _NEW + _COLOUR + _NIR, 9: _NEW + _WAVE, 10: _NEW + _COLOUR + _NIR + _WAVE}
# Fixed values end here.


def layout(head: bytes, path: str) -> dict:
    """Where the records of a file lie and how their numbers are scaled."""
    facts = las_header(head)
    if facts is None:
        raise ValueError(f"{path} is no LAS file")
    kind, length = head[104], struct.unpack_from("<H", head, 105)[0]
    if kind & 0xC0:
        raise ValueError(f"{path} is compressed")
    if kind not in FORMATS or length < np.dtype(FORMATS[kind]).itemsize:
        raise ValueError(f"{path}: point format {kind} with {length} bytes")
    return facts | {"kind": kind, "length": length, "at": struct.unpack_from("<I", head, 96)[0], "scale": struct.unpack_from("<3d", head, 131), "shift": struct.unpack_from("<3d", head, 155)}


def outside(facts: dict, box: Box | None) -> bool:
    return box is not None and (facts["xmax"] < box[0] or facts["ymax"] < box[1] or facts["xmin"] > box[2] or facts["ymin"] > box[3])


def read_part(file: Ranges, start: int, stop: int, box: Box | None = None) -> Iterator[pa.RecordBatch]:
    """The points of the records that begin in a byte range, where they lie in the rectangle."""
    facts = layout(file.read(0, HEADER_BYTES), file.path)
    if outside(facts, box):
        return
    at, length = facts["at"], facts["length"]
    record = lambda b: min(facts["n_points"], max(0, -(-(b - at) // length)))
    fields = FORMATS[facts["kind"]]
    plain = np.dtype(fields)
    kind = np.dtype({"names": plain.names, "formats": [plain.fields[n][0] for n in plain.names], "offsets": [plain.fields[n][1] for n in plain.names], "itemsize": length})
    for k in range(record(start), record(stop), RECORDS):
        n = min(RECORDS, record(stop) - k)
        held = file.read(at + k * length, n * length)
        if len(held) < n * length:
            raise ValueError(f"{file.path} ends before its last point")
        raw = np.frombuffer(held, kind)
        xyz = [raw[c] * facts["scale"][i] + facts["shift"][i] for i, c in enumerate("xyz")]
        if box is not None:
            keep = (xyz[0] >= box[0]) & (xyz[1] >= box[1]) & (xyz[0] <= box[2]) & (xyz[1] <= box[3])
            raw, xyz = raw[keep], [v[keep] for v in xyz]
        new = facts["kind"] > 5
        bits, mask = (4, 15) if new else (3, 7)
        more = lambda c: pa.array(raw[c].astype(np.int32)) if c in plain.names else pa.nulls(len(raw), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array([file.path] * len(raw), pa.string()), *map(pa.array, xyz), more("intensity"), pa.array((raw["returns"] & mask).astype(np.int32)), pa.array((raw["returns"] >> bits & mask).astype(np.int32)),
             pa.array((raw["cls"] if new else raw["cls"] & 31).astype(np.int32)), pa.array(raw["angle"] * (0.006 if new else 1.0)), more("user"), more("source"),
             pa.array(raw["gps"].copy()) if "gps" in plain.names else pa.nulls(len(raw), pa.float64()), *map(more, ("red", "green", "blue", "nir"))],
            schema=_ARROW,
        )


class _Points(DataSourceReader):
    def __init__(self, given: dict):
        self.paths, self.split, self.box = options(given)

    def partitions(self):
        return parts(self.paths, (".las",), self.split)

    def read(self, partition: Part):
        with Ranges(partition.path) as file:
            yield from read_part(file, partition.start, partition.stop, self.box)


class _PointsPushed(Pushed, _Points):
    pass


class LasPoints(DataSource):
    """Options: ``path``, or ``paths`` as a JSON list, of files and folders; ``box`` as ``xmin,ymin,xmax,ymax``; ``split`` in bytes."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        given = dict(self.options)
        return _PointsPushed(given) if given.get("push") == "true" else _Points(given)


class _Headers(DataSourceReader):
    def __init__(self, given: dict):
        self.paths = options(given)[0]

    def partitions(self):
        return parts(self.paths, (".las", ".laz"), 1 << 62)

    def read(self, partition: Part):
        with Ranges(partition.path) as file:
            facts = las_header(file.read(0, HEADER_BYTES)) or {}
        yield pa.RecordBatch.from_pylist([{"path": partition.path, **facts}], _HEADER_ARROW)


class LasHeaders(DataSource):
    """One row a file: what its first bytes say, nulls where it is no LAS file."""

    @classmethod
    def name(cls) -> str:
        return "las_headers"

    def schema(self) -> str:
        return _HEADER

    def reader(self, schema) -> DataSourceReader:
        return _Headers(dict(self.options))


def headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    spark.dataSource.register(LasHeaders)
    return spark.read.format("las_headers").option("paths", json.dumps(paths)).load()


def points(spark: SparkSession, paths: list[str], box: Box | None = None, split: int | None = None) -> DataFrame:
    """Points of LAS files and of all LAS files in folders, in a rectangle if one is given."""
    spark.dataSource.register(LasPoints)
    reader = spark.read.format("las").option("paths", json.dumps(paths)).option("push", spark.conf.get(PUSH, "false"))
    if box is not None:
        reader = reader.option("box", ",".join(map(repr, map(float, box))))
    if split is not None:
        reader = reader.option("split", split)
    return reader.load()


def encode(x: np.ndarray, y: np.ndarray, z: np.ndarray, cls: np.ndarray | None = None, kind: int = 6, scale: float = 0.001, year: int = 2024, software: str = "timberline", **more: np.ndarray) -> bytes:
    """A LAS 1.4 file; ``more`` may have ``intensity, returns, user, source, gps, red, green, blue, nir``, ``returns`` as the packed byte."""
    raw = np.zeros(len(x), np.dtype(FORMATS[kind]))
    xyz = [np.asarray(v, float) for v in (x, y, z)]
    shift = [float(np.floor(v.min())) if len(v) else 0.0 for v in xyz]
    for c, v, s in zip("xyz", xyz, shift):
        raw[c] = np.rint((v - s) / scale)
    if cls is not None:
        raw["cls"] = cls
    for c, v in more.items():
        raw[c] = v
    head = bytearray(HEADER_BYTES)
    head[:4], head[24], head[25] = b"LASF", 1, 4
    head[58 : 58 + len(software)] = software.encode()
    struct.pack_into("<HHHII", head, 90, 1, year, HEADER_BYTES, HEADER_BYTES, 0)
    struct.pack_into("<BHI", head, 104, kind, raw.dtype.itemsize, 0)
    struct.pack_into("<6d", head, 131, scale, scale, scale, *shift)
    held = [raw[c] * scale + s for c, s in zip("xyz", shift)]
    ends = [e for v in held for e in ((float(v.max()), float(v.min())) if len(v) else (0.0, 0.0))]
    struct.pack_into("<6d", head, 179, *ends)
    struct.pack_into("<Q", head, 247, len(raw))
    return bytes(head) + raw.tobytes()


def write_points(cloud: DataFrame, folder: str, kind: int = 6, scale: float = 0.001) -> list[str]:
    """Points ``(x, y, z, classification)`` as LAS files, and the list of files: one for each ``FILE`` points of a task, which holds no more at once.

    Files carry a name of their attempt, so that a task that runs again leaves no double: only listed files count.
    """

    def write(held: list) -> str:
        cols = {c: np.concatenate([f[c].to_numpy() for f in held]) for c in ("x", "y", "z", "classification")}
        path = f"{folder.rstrip('/')}/part-{uuid.uuid4().hex}.las"
        fs, inner = pafs.FileSystem.from_uri(path)
        fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(inner) as out:
            out.write(encode(cols["x"], cols["y"], cols["z"], cols["classification"], kind, scale))
        return path

    def run(frames):
        import pandas as pd

        held, n = [], 0
        for f in frames:
            held, n = [*held, f], n + len(f)
            if n >= limit:
                yield pd.DataFrame({"path": [write(held)]})
                held, n = [], 0
        if n:
            yield pd.DataFrame({"path": [write(held)]})

    limit = FILE
    rows = cloud.select(*[F.col(c).cast("double") for c in "xyz"], F.coalesce(F.col("classification").cast("int"), F.lit(0)).alias("classification")).filter("x is not null and y is not null and z is not null")
    return sorted(r["path"] for r in rows.mapInPandas(run, "path string").collect())
