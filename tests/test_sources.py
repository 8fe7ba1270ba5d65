import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from timberline.operators import pointcloud
from timberline.sources import acquisition as acq
from timberline.sources import cache, catalog, sinks
from timberline.sources import las as las_source
from timberline.streaming import tiles


def test_tile_names(spark):
    rows = [("/a/LHD_FXX_0186_6834_PTS_C_LAMB93_IGF69.copc.laz", "laz"), ("/a/LHD_FXX_0186_6834_MNT_O_0M50_.tif", "mnt"), ("/a/un_fichier.laz", "laz")]
    files = spark.createDataFrame(rows, "path string, type string")
    got = {r.path: r for r in catalog.parse_tiles(files).collect()}
    assert got[rows[0][0]].cle == got[rows[1][0]].cle == "0186_6834" and got[rows[2][0]].cle is None
    assert (got[rows[0][0]].xmin, got[rows[0][0]].ymin) == (186000, 6833000)
    one = catalog.catalog(files).collect()
    assert len(one) == 1 and one[0].laz == rows[0][0] and one[0].mnh is None


def las(year=2023):
    b = bytearray(227)
    b[:4], b[24], b[25] = b"LASF", 1, 2
    b[58:63] = b"maker"
    struct.pack_into("<HH", b, 90, 12, year)
    struct.pack_into("<I", b, 107, 77)
    struct.pack_into("<6d", b, 179, 2, 1, 4, 3, 6, 5)
    return bytes(b)


def test_headers_never_fail(spark):
    df = spark.createDataFrame([("a", las()), ("b", b"junk"), ("c", None), ("d", las(2021))], "path string, content binary")
    got = {r.path: r for r in catalog.read_headers(df).collect()}
    assert got["a"].annee == 2023 and got["a"].n_points == 77 and got["a"].xmin == 1 and got["b"].annee is None and got["c"].n_points is None
    assert catalog.homogeneity(catalog.read_headers(df)).first().heterogene


def test_bisection_only_for_size():
    calls = []

    def fetch(box):
        calls.append(box)
        return acq.Answer("volume") if box == (0, 0, 8, 8) else acq.Answer("ok", [box])

    assert len(acq.harvest(fetch, (0, 0, 8, 8))) == 4 and len(calls) == 5
    calls.clear()
    with pytest.raises(acq.Refused):
        acq.harvest(lambda b: calls.append(b) or acq.Answer("quota"), (0, 0, 8, 8))
    assert len(calls) == 1


def test_servers_in_turn_and_patience():
    asked, slept = [], []

    def transport(server, box):
        asked.append(server)
        return acq.Answer("ok", []) if len(asked) > 3 else acq.Answer("quota", wait=2)

    assert acq.ask(transport, ["a", "b"], (0, 0, 1, 1), sleep=slept.append).status == "ok"
    assert asked == ["a", "b", "a", "b"] and slept == [2]
    assert acq.ask(lambda s, b: acq.Answer("quota", wait=60), ["a"], (0, 0, 1, 1), sleep=slept.append).status == "quota" and slept == [2]
    assert 'way["highway"~"^(track)$"](1.000000,2.000000,3.000000,4.000000)' in acq.request_text(("track",), 1, 2, 3, 4)


def test_cache_policies(spark, tmp_path):
    made = []

    def acquire():
        made.append(1)
        return spark.range(3)

    get = lambda p, **k: cache.cached(spark, f"file://{tmp_path}", "osm", "here", {"x": p}, acquire, **k).count()
    assert get(1) == 3 and get(1) == 3 and len(made) == 1
    assert get(2, policy="avertir") == 3 and get(2, policy="ignorer") == 3 and len(made) == 1
    with pytest.raises(ValueError):
        get(2, policy="echouer")
    assert get(2) == 3 and len(made) == 2
    assert cache.differences({"source": "a", "parameters": {"x": 1, "y": 2}}, "b", {"x": 1, "z": 3}) == ["y", "z", "source"]
    assert cache.cached(spark, f"file://{tmp_path}", "none", "here", {}, lambda: None) is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, "en_service")], "id long, x1 double, y1 double, x2 double, y2 double, etat string")
    assert spark.read.parquet(sinks.write_layers({"net": df}, str(tmp_path / "out"))[0]).count() == 1
    with pytest.raises(ValueError):
        sinks.write_layers({"": df}, str(tmp_path))
    sinks.write_geopackage({"net": df}, str(tmp_path / "n.gpkg"))
    row = sqlite3.connect(tmp_path / "n.gpkg").execute("SELECT geom, etat FROM net").fetchone()
    assert row[0][:2] == b"GP" and row[1] == "en_service"
    assert 'attr="etat"' in sinks.categorised_style("etat", ["en_service", "abandonnee"])
    assert "| en_service |" in sinks.report({"Etat": df.select("etat")})


def test_points_and_stream(spark, tmp_path):
    pts = spark.createDataFrame([("t", 0, 0, 0.1, 2), ("t", 0, 0, 1.0, 1), ("t", 0, 0, 9.0, 5), ("t", 0, 1, 4.0, 17)], "tile_key string, row int, col int, h double, cls int")
    got = {(r.row, r.col): r for r in pointcloud.point_layers(pts).collect()}
    assert got[0, 0].densite_sol == 1 and got[0, 0].densite_sousetage == 1 and got[0, 0].hauteur_couvert == 9 and got[0, 1].masque_pont == 1
    pts.write.parquet(str(tmp_path / "in"))
    stream = tiles.count_cells(tiles.arriving_points(spark, str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("cells").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.row, r.col): r.n_points for r in spark.table("cells").collect()} == {(0, 0): 3, (0, 1): 1}


def test_points_by_box_and_corridor(spark, tmp_path):
    from timberline.sources import points as pts

    rows = [("a", float(x), float(y), 1.0) for x in range(0, 200, 10) for y in range(0, 200, 10)]
    spark.createDataFrame(rows, "tile_key string, x double, y double, z double").write.parquet(str(tmp_path / "p"))
    df = pts.read_points(spark, [str(tmp_path / "p")], (0, 0, 50, 50))
    assert df.count() == 36 and "PushedFilters: [IsNotNull(x)" in df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    line = spark.createDataFrame([(0.0, 0.0, 190.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")
    near = pts.in_corridor(pts.read_points(spark, [str(tmp_path / "p")]), line, 15.0)
    assert near.count() == 40
    with pytest.raises(ValueError):
        pts.require_paths([])


def test_heights_above_ground(spark):
    grid = {"xmin": 0.0, "ymin": 0.0, "xmax": 2.0, "ymax": 2.0, "res": 1.0, "nrow": 2, "ncol": 2}
    ground = spark.createDataFrame([(0, 0, 100.0), (0, 1, 110.0)], "row int, col int, z double")
    pts = spark.createDataFrame([(0.5, 1.5, 103.0), (1.5, 1.5, 110.0), (0.5, 0.5, 99.0), (9.0, 9.0, 1.0)], "x double, y double, z double")
    assert sorted((r.x, r.y, r.h) for r in pointcloud.normalised(pts, ground, grid).collect() if r.h is not None) == [(0.5, 1.5, 3.0), (1.5, 1.5, 0.0)]
    assert pointcloud.normalised(pts, ground, grid).count() == 3


def test_a_death_between_table_and_manifest_leaves_the_old_layer(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}"
    get = lambda p, n: cache.cached(spark, folder, "osm", "here", {"x": p}, lambda: spark.range(n))
    old = get(1, 3)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(cache, "write_provenance", dies)
        with pytest.raises(RuntimeError):
            get(2, 5)
    # the layer that counts is whole and has its own parameters
    assert cache.read_provenance(spark, cache.paths(folder, "osm")[1])["parameters"] == {"x": 1}
    assert cache.cached(spark, folder, "osm", "here", {"x": 1}, dies, "echouer").count() == 3
    assert get(2, 6).count() == 6
    assert old.count() == 3  # who reads the version before still can
    get(3, 7), get(4, 8)
    assert len(list((tmp_path / "osm.versions").iterdir())) == 2


def test_las_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(las_source, "FILE", 100)
    cloud = spark.range(950).coalesce(1).select((F.col("id") % 31).cast("double").alias("x"), (F.col("id") % 17).cast("double").alias("y"), F.col("id").cast("double").alias("z"), F.lit(2).alias("classification"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        files = las_source.write_points(cloud, f"file://{tmp_path}/las")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(files) == 10
    assert sorted(r.z for r in las_source.points(spark, files).collect()) == [float(k) for k in range(950)]
