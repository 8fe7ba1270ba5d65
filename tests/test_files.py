"""LAS and TIFF files read by ranges."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.sources import las, ranges, tiff


def cloud(n=5000, seed=0):
    rng = np.random.default_rng(seed)
    return rng.random(n) * 90 + 400, rng.random(n) * 70 + 900, rng.random(n) * 30, rng.integers(1, 20, n)


@pytest.fixture
def folder(tmp_path):
    for k in range(3):
        x, y, z, c = cloud(seed=k)
        (tmp_path / f"t{k}.las").write_bytes(las.encode(x + 1000 * k, y, z, c, year=2020 + k))
    (tmp_path / "junk.las").write_bytes(b"no points here")
    (tmp_path / "note.txt").write_bytes(b"LASF")
    return tmp_path


@pytest.mark.parametrize("kind", sorted(las.FORMATS))
def test_points_of_each_format(tmp_path, kind):
    x, y, z, c = cloud(100)
    rng = np.random.default_rng(kind)
    c = c % 20
    has = set(np.dtype(las.FORMATS[kind]).names)
    more = {n: rng.integers(0, 255, 100) for n in ("intensity", "returns", "user", "source", "gps", "red", "green", "blue", "nir") if n in has}
    path = tmp_path / "a.las"
    path.write_bytes(las.encode(x, y, z, c, kind, **more))
    with ranges.Ranges(str(path)) as file:
        got = [r for b in las.read_part(file, 0, path.stat().st_size) for r in b.to_pylist()]
    assert np.allclose([(r["x"], r["y"], r["z"]) for r in got], np.stack([x, y, z], axis=1), atol=6e-4)
    assert [r["classification"] for r in got] == (c if kind > 5 else c & 31).tolist()
    mask, bits = (15, 4) if kind > 5 else (7, 3)
    assert [r["return_number"] for r in got] == (more["returns"] & mask).tolist() and [r["returns"] for r in got] == (more["returns"] >> bits & mask).tolist()
    for name, field in (("gps_time", "gps"), ("red", "red"), ("nir", "nir"), ("intensity", "intensity"), ("source", "source"), ("user_data", "user")):
        assert [r[name] for r in got] == (more[field].tolist() if field in has else [None] * 100)


def test_only_the_asked_bytes_are_read(folder):
    path = str(folder / "t0.las")
    size, each = (folder / "t0.las").stat().st_size, np.dtype(las.FORMATS[6]).itemsize
    with ranges.Ranges(path) as file:
        list(las.read_part(file, 0, size, (0.0, 0.0, 300.0, 300.0)))
        assert file.taken == las.HEADER_BYTES  # another place: the header says so
    seen = 0
    for start in range(0, size, 40_000):
        with ranges.Ranges(path) as file:
            n = sum(len(b) for b in las.read_part(file, start, min(size, start + 40_000)))
            assert file.taken == las.HEADER_BYTES + n * each and n <= 40_000 // each + 1
            seen += n
    assert seen == 5000


def test_points_and_headers_through_spark(spark, folder):
    files = [str(folder / f"t{k}.las") for k in range(3)]
    whole = las.points(spark, files, split=50_000)
    assert whole.count() == 15_000 and whole.rdd.getNumPartitions() == 12
    box = (1420.0, 910.0, 1450.5, 940.0)
    want = sum((x + 1000 >= box[0]) & (x + 1000 <= box[2]) & (y >= box[1]) & (y <= box[3]) for x, y in [tuple(np.round(v, 3) for v in cloud(seed=1)[:2])])
    assert las.points(spark, files, box).count() == want.sum()
    assert whole.filter("x between 1420 and 1450.5 and y between 910 and 940").count() == want.sum()
    heads = {r.path.rsplit("/", 1)[1]: r for r in las.headers(spark, [str(folder)]).collect()}
    assert set(heads) == {"t0.las", "t1.las", "t2.las", "junk.las"}
    assert [heads[f"t{k}.las"].annee for k in range(3)] == [2020, 2021, 2022] and heads["t1.las"].n_points == 5000 and heads["junk.las"].version is None
    with pytest.raises(Exception, match="no LAS file"):
        las.points(spark, [str(folder)]).count()


def test_filters_reach_the_reader(spark, folder):
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    source = las.LasPoints({"path": str(folder / "t0.las"), "push": "true"}).reader(None)
    assert len(list(source.pushFilters([GreaterThanOrEqual(("x",), 500.0), LessThan(("y",), 80), LessThan(("z",), 1)]))) == 3
    assert source.box == (500.0, -np.inf, np.inf, 80.0)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", None)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert las.points(spark, [str(folder / "t0.las")]).filter("x >= 450 and classification = 3").count() == int(((np.round(cloud()[0], 3) >= 450) & (cloud()[3] == 3)).sum())
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before or "false")


def test_compressed_short_and_missing_files(spark, tmp_path):
    x, y, z, c = cloud(10)
    raw = bytearray(las.encode(x, y, z, c))
    (tmp_path / "short.las").write_bytes(raw[:-5])
    with ranges.Ranges(str(tmp_path / "short.las")) as file, pytest.raises(ValueError, match="ends before"):
        list(las.read_part(file, 0, len(raw)))
    raw[104] |= 0x80
    (tmp_path / "packed.las").write_bytes(raw)
    with ranges.Ranges(str(tmp_path / "packed.las")) as file, pytest.raises(ValueError, match="compressed"):
        list(las.read_part(file, 0, len(raw)))
    with pytest.raises(Exception):
        las.points(spark, [str(tmp_path / "none.las")]).count()
    (tmp_path / "empty.las").write_bytes(las.encode(x[:0], y[:0], z[:0]))
    assert las.points(spark, [str(tmp_path / "empty.las")]).count() == 0


def test_written_points_come_back(spark, tmp_path):
    x, y, z, c = cloud(700)
    df = spark.createDataFrame([(float(a), float(b), float(d), int(k)) for a, b, d, k in zip(x, y, z, c)] + [(None, 1.0, 1.0, 2)], "x double, y double, z double, classification int").repartition(3)
    files = las.write_points(df, str(tmp_path / "out"))
    got = las.points(spark, files).select("x", "y", "z", "classification").collect()
    assert len(files) == 3 and sorted(tuple(round(v, 3) for v in r) for r in got) == sorted(tuple(round(float(v), 3) for v in r) for r in zip(x, y, z, c))


# ---------------------------------------------------------------- rasters


def pack_lzw(data: bytes) -> bytes:
    """LZW as TIFF has it, for the tests."""
    words, width, held, bits, out, word = {bytes([k]): k for k in range(256)}, 9, 0, 0, bytearray(), b""

    def put(code):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)

    put(256)
    n = 258
    for k in range(len(data)):
        more = word + data[k : k + 1]
        if more in words:
            word = more
            continue
        put(words[word])
        words[more] = n
        n += 1
        if n in (512, 1024, 2048):
            width += 1
        word = data[k : k + 1]
        if n == 4094:
            put(words[word])
            word = b""
            put(256)
            words, width, n = {bytes([k]): k for k in range(256)}, 9, 258
    if word:
        put(words[word])
        n += 1
        if n in (512, 1024, 2048):
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def raster(values, order="<", big=False, tile=None, rows=7, compression=1, predictor=1, planes=False):
    """A TIFF by the letter of its layout, other than by the library's own writer."""
    h, w, bands = values.shape
    kind = values.dtype.newbyteorder(order)
    parts = [values[:, :, b : b + 1] for b in range(bands)] if planes else [values]
    blocks = []
    for part in parts:
        for i in range(0, h, tile or rows):
            for j in range(0, w, tile or w):
                block = part[i : i + (tile or rows), j : j + (tile or w)]
                if tile:
                    block = np.pad(block, ((0, tile - block.shape[0]), (0, tile - block.shape[1]), (0, 0)))
                if predictor == 2:
                    u = block.view(f"u{kind.itemsize}").copy()
                    u[:, 1:] -= block.view(f"u{kind.itemsize}")[:, :-1]
                    block = u.view(block.dtype)
                data = np.ascontiguousarray(block).astype(kind).tobytes()
                if predictor == 3:
                    n, m, k = block.shape
                    bytes_ = np.ascontiguousarray(block.astype(kind.newbyteorder(">"))).view(np.uint8).reshape(n, m * k, kind.itemsize).transpose(0, 2, 1).reshape(n, -1).copy()
                    bytes_[:, k:] -= bytes_[:, :-k].copy()
                    data = bytes_.tobytes()
                blocks.append(pack_lzw(data) if compression == 5 else zlib.compress(data) if compression == 8 else data)
    word, count = ("Q", "Q") if big else ("I", "H")
    body, places = b"", []
    at = 16 if big else 8
    for b in blocks:
        places.append(at + len(body))
        body += b
    entries = {256: (4, [w]), 257: (4, [h]), 258: (3, [kind.itemsize * 8] * bands), 259: (3, [compression]), 277: (3, [bands]), 284: (3, [2 if planes else 1]), 317: (3, [predictor]), 339: (3, [{"u": 1, "i": 2, "f": 3}[kind.kind]] * bands),
               33550: (12, [2.0, 2.0, 0.0]), 33922: (12, [0.0, 0.0, 0.0, 1000.0, 5000.0, 0.0]), 42113: (2, list(b"-99\0"))}
    entries |= {322: (4, [tile]), 323: (4, [tile]), 324: (4, places), 325: (4, [len(b) for b in blocks])} if tile else {278: (4, [rows]), 273: (4, places), 279: (4, [len(b) for b in blocks])}
    ifd, rest = at + len(body), b""
    size, room = (20, 8) if big else (12, 4)
    free = ifd + (8 if big else 2) + size * len(entries) + (8 if big else 4)
    table = b""
    for tag in sorted(entries):
        t, data = entries[tag]
        raw = struct.pack(order + str(len(data)) + {2: "B", 3: "H", 4: "I", 12: "d"}[t], *data)
        place = raw.ljust(room, b"\0") if len(raw) <= room else struct.pack(order + word, free + len(rest))
        rest += raw if len(raw) > room else b""
        table += struct.pack(order + "HH" + word, tag, t, len(data)) + place
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "H", 43 if big else 42) + (struct.pack(order + "HHQ", 8, 0, ifd) if big else struct.pack(order + "I", ifd))
    return head + body + struct.pack(order + count, len(entries)) + table + b"\0" * (8 if big else 4) + rest


def sample(kind, bands=1, seed=2):
    rng = np.random.default_rng(seed)
    v = (np.cumsum(rng.random((53, 41, bands)), axis=1) * 9).astype(kind)
    v[3, 4] = -99 if np.dtype(kind).kind != "u" else 99
    return v


@pytest.mark.parametrize("options", [
    {}, {"order": ">"}, {"big": True}, {"tile": 16}, {"tile": 16, "compression": 8, "predictor": 2}, {"compression": 5}, {"compression": 5, "predictor": 2, "order": ">"},
    {"tile": 16, "compression": 5, "kind": "f4", "predictor": 3}, {"kind": "f8", "predictor": 3, "compression": 8, "bands": 2}, {"bands": 3, "tile": 16, "planes": True}, {"kind": "u1", "compression": 5, "rows": 53}, {"kind": "i2", "predictor": 2, "bands": 2, "big": True, "order": ">"},
])
def test_cells_of_each_layout(tmp_path, options):
    options = dict(options)
    values = sample(options.pop("kind", "i4"), options.pop("bands", 1))
    path = tmp_path / "a.tif"
    path.write_bytes(raster(values, **options))
    got = {}
    for k in range(3):  # in three parts
        with ranges.Ranges(str(path)) as file:
            for batch in tiff.read_part(file, k, 3):
                for r in batch.to_pylist():
                    got[r["row"], r["col"], r["band"]] = r
    assert len(got) == values.size
    for (i, j, b), r in got.items():
        v = float(values[i, j, b - 1])
        assert r["value"] == (None if v == -99 else v) and (r["x"], r["y"]) == (1000 + 2 * (j + 0.5), 5000 - 2 * (i + 0.5))


def test_only_the_chunks_of_a_rectangle_are_read(tmp_path, spark):
    values = np.arange(640 * 640, dtype=float).reshape(640, 640)
    path = tmp_path / "b.tif"
    path.write_bytes(tiff.encode(values, 1000.0, 5000.0, 2.0, chunk=64, packed=False))
    box = (1130.0, 4500.0, 1380.0, 4740.0)
    want = {(i, j) for i in range(640) for j in range(640) if box[0] <= 1000 + 2 * (j + 0.5) <= box[2] and box[1] <= 5000 - 2 * (i + 0.5) <= box[3]}
    with ranges.Ranges(str(path)) as file:
        got = {(r["row"], r["col"]): r["value"] for b in tiff.read_part(file, 0, 1, box) for r in b.to_pylist()}
        directory = ranges.Ranges(str(path))
        tiff.directory(directory)
        chunks = {(i // 64, j // 64) for i, j in want}
        near = {(i // 64, j // 64) for r, c in want for i in (r - 1, r + 1) for j in (c - 1, c + 1)}
        each = 64 * 64 * 8
        assert directory.taken + len(chunks) * each <= file.taken <= directory.taken + len(near) * each < path.stat().st_size / 4
    assert set(got) == want and all(v == values[k] for k, v in got.items())
    whole = tiff.cells(spark, [str(path)], box, split=100_000)
    assert whole.count() == len(want) and whole.rdd.getNumPartitions() > 10
    assert tiff.cells(spark, [str(path)], (0.0, 0.0, 1.0, 1.0)).count() == 0


def test_written_rasters_come_back(spark, tmp_path):
    rows = [(r, c, float(r * 100 + c)) for r in range(70) for c in range(90) if (r + c) % 7]
    df = spark.createDataFrame(rows, "row int, col int, z double")
    grid = {"xmin": 10.0, "ymax": 500.0, "res": 0.5, "nrow": 70, "ncol": 90}
    files = tiff.write_rasters(df, grid, str(tmp_path / "out"), "z", tile=32, chunk=16)
    got = tiff.cells(spark, files).filter("value is not null").collect()
    assert len(files) == 9
    assert sorted((round((500 - r.y) / 0.5 - 0.5), round((r.x - 10) / 0.5 - 0.5), r.value) for r in got) == rows
    (tmp_path / "junk.tif").write_bytes(b"II*")
    with pytest.raises(Exception, match="no TIFF"):
        tiff.cells(spark, [str(tmp_path / "junk.tif")]).count()


def test_a_rectangle_skips_most_of_what_lies_along_the_curve(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    from timberline.sources import points

    rng = np.random.default_rng(4)
    xy = np.concatenate([rng.random((4000, 2)) * 1000 - 300, rng.random((4000, 2)) * 20 + 400])
    df = spark.createDataFrame([(float(a), float(b), k) for k, (a, b) in enumerate(xy)], "x double, y double, k int").repartition(5)
    points.write_by_curve(df, str(tmp_path / "z"), files=40)
    box = (100.0, 100.0, 180.0, 190.0)
    got = points.read_points(spark, [str(tmp_path / "z")], box)
    want = [k for k, (a, b) in enumerate(xy) if box[0] <= a <= box[2] and box[1] <= b <= box[3]]
    assert sorted(r.k for r in got.collect()) == want and len(want) > 10
    groups = [g.row_group(i) for f in glob.glob(f"{tmp_path}/z/*.parquet") for g in [pq.ParquetFile(f).metadata] for i in range(g.num_row_groups)]
    stats = lambda g, c: next(g.column(i).statistics for i in range(g.num_columns) if g.column(i).path_in_schema == c)
    met = [g for g in groups if stats(g, "x").min <= box[2] and stats(g, "x").max >= box[0] and stats(g, "y").min <= box[3] and stats(g, "y").max >= box[1]]
    assert len(groups) >= 35 and len(met) <= 6
    # the cluster is cut as finely as the rest
    assert max(g.num_rows for g in groups) < 3 * 8000 / len(groups)


def test_the_curve_keeps_neighbours_together(spark):
    from timberline.sources import points

    df = spark.createDataFrame([(x, y) for x in range(8) for y in range(8)], "x int, y int").withColumn("z", points.curve_key(F.col("x"), F.col("y")))
    ranked = [(r.x, r.y) for r in df.orderBy("z").collect()]
    for k in range(0, 64, 16):
        part = ranked[k : k + 16]
        assert max(x for x, _ in part) - min(x for x, _ in part) == 3 and max(y for _, y in part) - min(y for _, y in part) == 3
