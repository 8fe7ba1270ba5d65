"""TIFF rasters by byte ranges, as a Spark data source; a sink that writes a raster by tiles.

A task reads the directory of its file (some hundred bytes and the list of chunks), then the strips or tiles that are
its part of the file and meet the asked rectangle, each by its own range. Classic and BigTIFF, both byte orders; chunks that are plain,
deflated or LZW-packed; no predictor, the horizontal one, the one for floating numbers. Placement is that of north-up GeoTIFF.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from timberline.sources.ranges import PUSH, Box, Part, Pushed, Ranges, options, parts

SCHEMA = "path string, band int, row long, col long, x double, y double, value double"
_ARROW = pa.schema([("path", pa.string()), ("band", pa.int32()), ("row", pa.int64()), ("col", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("value", pa.float64())])

# Types and tags of the public format.
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, NODATA = 33550, 33922, 42113
# Fixed values end here.


def directory(file: Ranges) -> dict:
    """The tags of the first image, with ``order``."""
    head = file.read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack_from(order + "H", head, 2)[0] if order and len(head) >= 8 else 0
    if version not in (42, 43):
        raise ValueError(f"{file.path} is no TIFF file")
    big = version == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)[0]
    count = struct.unpack(order + ("Q" if big else "H"), file.read(at, 8 if big else 2))[0]
    size, room = (20, 8) if big else (12, 4)
    table = file.read(at + (8 if big else 2), count * size)
    tags: dict = {"order": order}
    for k in range(count):
        tag, kind = struct.unpack_from(order + "HH", table, k * size)
        n = struct.unpack_from(order + ("Q" if big else "I"), table, k * size + 4)[0]
        if kind not in _TYPES:
            continue
        form = order + _TYPES[kind] * (n if kind != 2 else 0) if kind != 2 else f"{order}{n}s"
        length = struct.calcsize(form)
        place = k * size + (12 if big else 8)
        data = table[place : place + room] if length <= room else file.read(struct.unpack_from(order + ("Q" if big else "I"), table, place)[0], length)
        tags[tag] = struct.unpack_from(form, data)
    return tags


def unpack_lzw(data: bytes) -> bytes:
    """Codes of growing width, highest bit first, as TIFF packs them."""
    out, held, bits, width, before = bytearray(), 0, 0, 9, b""
    words: list[bytes] = [bytes([k]) for k in range(256)] + [b"", b""]
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            del words[258:]
            width, before = 9, b""
            continue
        word = words[code] if code < len(words) else before + before[:1]
        out += word
        if before:
            words.append(before + word[:1])
            if len(words) in (511, 1023, 2047):
                width += 1
        before = word
    return bytes(out)


class Raster:
    """What the directory says: chunks, their kind, and where cells lie."""

    def __init__(self, tags: dict, path: str = ""):
        one = lambda t, default=None: tags[t][0] if t in tags else default
        self.tags, self.path = tags, path
        self.width, self.height, self.samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
        if self.width is None or self.height is None:
            raise ValueError(f"{path} has no image")
        bits, form = one(BITS, 1), one(FORMAT, 1)
        if bits not in (8, 16, 32, 64) or form not in (1, 2, 3):
            raise ValueError(f"{path}: {bits} bits of format {form}")
        self.kind = np.dtype(f"{tags['order']}{'uif'[form - 1]}{bits // 8}")
        self.compression, self.predictor, self.planes = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1) == 2
        self.tiled = TILES in tags
        self.chunk = (one(TILE_HEIGHT), one(TILE_WIDTH)) if self.tiled else (min(one(STRIP_ROWS, self.height), self.height), self.width)
        self.offsets, self.sizes = (tags[TILES], tags[TILE_BYTES]) if self.tiled else (tags[STRIPS], tags[STRIP_BYTES])
        self.across, self.down = -(-self.width // self.chunk[1]), -(-self.height // self.chunk[0])
        scale, tie = tags.get(PIXEL_SCALE, (1.0, 1.0)), tags.get(TIE_POINT)
        self.step = (scale[0], scale[1])
        self.corner = (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]) if tie else (0.0, float(self.height) * scale[1])
        text = tags[NODATA][0].split(b"\0")[0].strip() if NODATA in tags else b""
        self.nodata = float(text) if text else None

    def window(self, box: Box | None) -> tuple[int, int, int, int]:
        """First and last row and column, ends exclusive, whose cell centres may lie in the rectangle."""
        if box is None:
            return 0, self.height, 0, self.width
        clip = lambda v, n: int(min(n, max(0.0, v)))
        (x, y), (dx, dy) = self.corner, self.step
        return (clip(math.floor((y - box[3]) / dy - 1), self.height), clip(math.ceil((y - box[1]) / dy + 1), self.height),
                clip(math.floor((box[0] - x) / dx - 1), self.width), clip(math.ceil((box[2] - x) / dx + 1), self.width))

    def meeting(self, box: Box | None) -> list[int]:
        """Numbers of the chunks that meet the rectangle."""
        r0, r1, c0, c1 = self.window(box)
        if r0 >= r1 or c0 >= c1:
            return []
        h, w = self.chunk
        rows, cols = range(r0 // h, (r1 - 1) // h + 1), range(c0 // w, (c1 - 1) // w + 1)
        each = self.across * self.down
        return [p * each + i * self.across + j for p in range(self.samples if self.planes else 1) for i in rows for j in cols]

    def unpacked(self, data: bytes, number: int) -> tuple[int, int, int, np.ndarray]:
        """First band, row, column, and values (row, column, band) of a chunk."""
        if self.compression in (8, 32946):
            data = zlib.decompress(data)
        elif self.compression == 5:
            data = unpack_lzw(data)
        elif self.compression != 1:
            raise ValueError(f"{self.path}: compression {self.compression}")
        plane, at = divmod(number, self.across * self.down)
        i, j = divmod(at, self.across)
        h, w = self.chunk
        if not self.tiled:
            h = min(h, self.height - i * h)
        bands = 1 if self.planes else self.samples
        size = self.kind.itemsize
        raw = np.frombuffer(data, np.uint8, h * w * bands * size)
        if self.predictor == 3:
            flat = np.add.accumulate(raw.reshape(h, -1, bands), axis=1, dtype=np.uint8).reshape(h, size, w * bands)
            values = np.ascontiguousarray(flat.transpose(0, 2, 1)).view(self.kind.newbyteorder(">"))
        else:
            values = raw.view(self.kind).reshape(h, w, bands)
            if self.predictor == 2:
                own = values.astype(self.kind.newbyteorder("="))
                values = np.add.accumulate(own.view(f"u{size}"), axis=1, dtype=f"u{size}").view(own.dtype)
        values = values.reshape(h, w, bands)
        r0, c0 = i * self.chunk[0], j * w
        return plane, r0, c0, values[: self.height - r0, : self.width - c0].astype(float)


def read_part(file: Ranges, k: int, n: int, box: Box | None = None) -> Iterator[pa.RecordBatch]:
    """Cells of the chunks that are part ``k`` of ``n`` of a file and meet the rectangle."""
    raster = Raster(directory(file), file.path)
    total = len(raster.offsets)
    for number in raster.meeting(box):
        if number * n // total != k or not raster.sizes[number]:
            continue
        plane, r0, c0, values = raster.unpacked(file.read(raster.offsets[number], raster.sizes[number]), number)
        h, w, bands = values.shape
        row, col = np.repeat(np.arange(r0, r0 + h), w), np.tile(np.arange(c0, c0 + w), h)
        x, y = raster.corner[0] + (col + 0.5) * raster.step[0], raster.corner[1] - (row + 0.5) * raster.step[1]
        inside = np.ones(len(row), bool) if box is None else (x >= box[0]) & (y >= box[1]) & (x <= box[2]) & (y <= box[3])
        if not inside.any():
            continue
        for b in range(bands):
            v = values[:, :, b].ravel()[inside]
            absent = np.isnan(v) | (v == raster.nodata if raster.nodata is not None else False)
            m = int(inside.sum())
            yield pa.RecordBatch.from_arrays([pa.array([file.path] * m, pa.string()), pa.array(np.full(m, plane + b + 1, np.int32)), pa.array(row[inside]), pa.array(col[inside]), pa.array(x[inside]), pa.array(y[inside]), pa.array(v, mask=absent)], schema=_ARROW)


class _Cells(DataSourceReader):
    def __init__(self, given: dict):
        self.paths, self.split, self.box = options(given)

    def partitions(self):
        return parts(self.paths, (".tif", ".tiff"), self.split)

    def read(self, partition: Part):
        with Ranges(partition.path) as file:
            yield from read_part(file, partition.k, partition.n, self.box)


class _CellsPushed(Pushed, _Cells):
    pass


class TiffCells(DataSource):
    """Options: ``path``, or ``paths`` as a JSON list, of files and folders; ``box`` as ``xmin,ymin,xmax,ymax``; ``split`` in bytes."""

    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        given = dict(self.options)
        return _CellsPushed(given) if given.get("push") == "true" else _Cells(given)


def cells(spark: SparkSession, paths: list[str], box: Box | None = None, split: int | None = None) -> DataFrame:
    """Cells of TIFF rasters and of all rasters in folders, those with centres in a rectangle if one is given. Missing values are null."""
    spark.dataSource.register(TiffCells)
    reader = spark.read.format("tiff").option("paths", json.dumps(paths)).option("push", spark.conf.get(PUSH, "false"))
    if box is not None:
        reader = reader.option("box", ",".join(map(repr, map(float, box))))
    if split is not None:
        reader = reader.option("split", split)
    return reader.load()


def encode(values: np.ndarray, xmin: float, ymax: float, res: float, chunk: int | None = None, packed: bool = True, nodata: float | None = None) -> bytes:
    """A GeoTIFF of one array (row, column), in square chunks or in strips of 64 rows, deflated or plain."""
    h, w = values.shape
    kind = values.dtype.newbyteorder("<")
    blocks = []
    if chunk:
        for i in range(0, h, chunk):
            for j in range(0, w, chunk):
                block = np.zeros((chunk, chunk), kind)
                part = values[i : i + chunk, j : j + chunk]
                block[: part.shape[0], : part.shape[1]] = part
                blocks.append(block.tobytes())
    else:
        blocks = [values[i : i + 64].astype(kind).tobytes() for i in range(0, h, 64)]
    blocks = [zlib.compress(b) if packed else b for b in blocks]
    starts = np.cumsum([8] + [len(b) for b in blocks])
    places, sizes = [int(s) for s in starts[:-1]], [len(b) for b in blocks]
    entries = [(WIDTH, "I", [w]), (HEIGHT, "I", [h]), (BITS, "H", [kind.itemsize * 8]), (COMPRESSION, "H", [8 if packed else 1]), (SAMPLES, "H", [1]), (FORMAT, "H", [{"u": 1, "i": 2, "f": 3}[kind.kind]])]
    entries += [(TILE_WIDTH, "I", [chunk]), (TILE_HEIGHT, "I", [chunk]), (TILES, "I", places), (TILE_BYTES, "I", sizes)] if chunk else [(STRIP_ROWS, "I", [64]), (STRIPS, "I", places), (STRIP_BYTES, "I", sizes)]
    entries += [(PIXEL_SCALE, "d", [res, res, 0.0]), (TIE_POINT, "d", [0.0, 0.0, 0.0, xmin, ymax, 0.0])]
    if nodata is not None:
        entries.append((NODATA, "c", [bytes([c]) for c in f"{nodata!r}\0".encode()]))
    at = int(starts[-1])
    table, rest, free = [], b"", at + 2 + 12 * len(entries) + 4
    for tag, form, data in sorted(entries, key=lambda e: e[0]):
        raw = struct.pack(f"<{len(data)}{form}", *data)
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", free + len(rest))
        rest += raw if len(raw) > 4 else b""
        table.append(struct.pack("<HHI", tag, {"I": 4, "H": 3, "d": 12, "c": 2}[form], len(data)) + place)
    return b"II*\0" + struct.pack("<I", at) + b"".join(blocks) + struct.pack("<H", len(table)) + b"".join(table) + b"\0\0\0\0" + rest


def write_rasters(band: DataFrame, grid: dict, folder: str, value: str, tile: int = 1_024, chunk: int = 256) -> list[str]:
    """A band (``row, col`` and ``value``) as one GeoTIFF a tile, and the list of files; only listed files count, as with ``write_points``."""
    res = grid["res"]

    def run(key, pdf):
        tr, tc = int(key[0]), int(key[1])
        shape = (int(min(tile, grid["nrow"] - tr * tile)), int(min(tile, grid["ncol"] - tc * tile)))
        a = np.full(shape, np.nan, np.float64)
        a[pdf["row"].to_numpy(np.int64) - tr * tile, pdf["col"].to_numpy(np.int64) - tc * tile] = pdf["v"].to_numpy(float)
        path = f"{folder.rstrip('/')}/tile-{tr}-{tc}-{uuid.uuid4().hex}.tif"
        fs, inner = pafs.FileSystem.from_uri(path)
        fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(inner) as out:
            out.write(encode(a, grid["xmin"] + tc * tile * res, grid["ymax"] - tr * tile * res, res, chunk))
        return pd.DataFrame({"path": [path]})

    rows = band.select("row", "col", F.col(value).cast("double").alias("v"), F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc"))
    return sorted(r["path"] for r in rows.groupBy("tr", "tc").applyInPandas(run, "path string").collect())
