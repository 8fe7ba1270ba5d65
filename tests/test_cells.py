import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.operators import cells, learn, stencils
from timberline.operators.cells import Rule


def grid(n, m, res=1.0):
    return {"xmin": 0.0, "ymin": 0.0, "xmax": m * res, "ymax": n * res, "res": res, "nrow": n, "ncol": m}


def surface(spark, z):
    n, m = z.shape
    rows = [(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(n) for c in range(m)]
    return spark.createDataFrame(rows, "row int, col int, z double")


def array(df, band, shape):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", band).collect():
        out[r[0], r[1]] = np.nan if r[2] is None else r[2]
    return out


def test_states_and_null(spark):
    df = spark.createDataFrame([(0.9, 0.9), (0.9, 0.1), (0.1, 0.9), (0.1, 0.1), (None, 0.5)], "g double, s double")
    assert [r[0] for r in df.select(cells.state("g", "s")).collect()] == [1, 2, 3, 4, None]


def test_fusion_floor_null_and_no_match(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 0.5)], "vesselness double, rugosite double")
    rules = {"vesselness": Rule("up", 2.0, 0.0, 1.0), "rugosite": Rule("up", 1.0, 0.0, 1.0)}
    got = [r.sigma for r in cells.fuse(df, rules).collect()]
    assert got[1] is None and math.isclose(got[0], math.exp(math.log(0.05) / 3))
    with pytest.raises(ValueError):
        cells.fuse(df, {"nothing": Rule("up")})


def test_index_needs_weight(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.5, 0.0, 0.0)], "sigma_geo double, sigma_surf double, vesselness double, x double, y double")
    with pytest.raises(ValueError):
        cells.detection_index(df, {"geo": 0.0})


def test_box_mean_against_brute_force_with_gaps(spark):
    rng = np.random.default_rng(3)
    z = rng.random((13, 17))
    z[rng.random(z.shape) < 0.2] = np.nan
    got = array(stencils.box_mean(surface(spark, z), "z", 5, "m"), "m", z.shape)
    want = np.array([[np.nanmean(z[max(0, r - 2) : r + 3, max(0, c - 2) : c + 3]) for c in range(17)] for r in range(13)])
    assert np.allclose(got, want)


def test_tiles_do_not_show(spark):
    rng = np.random.default_rng(4)
    z = np.cumsum(rng.random((40, 50)), axis=0)
    df, g = surface(spark, z), grid(40, 50)
    for f in (lambda t: stencils.micro_relief(df, g, 3, 8, tile=t), lambda t: stencils.vesselness(df, g, (1, 2), c=1.0, tile=t)):
        a, b = f(64), f(17)
        for band in [c for c in a.columns if c not in ("row", "col")]:
            assert np.allclose(array(a, band, z.shape), array(b, band, z.shape), equal_nan=True)


def test_sky_of_plain_pit_and_peak(spark):
    z = np.full((21, 21), 100.0)
    flat = stencils.micro_relief(surface(spark, z), grid(21, 21), 5).agg(F.min("svf"), F.max("openness_pos")).first()
    assert flat[0] == 1.0 and math.isclose(flat[1], 90.0)
    pit, peak = z.copy(), z.copy()
    pit[10, 10] -= 10
    peak[10, 10] += 10
    at = lambda s: array(stencils.micro_relief(surface(spark, s), grid(21, 21), 5), "svf", s.shape)[10, 10]
    assert at(pit) < 1 and at(peak) == 1.0


def test_diagonal_valley(spark):
    y, x = np.mgrid[0:70, 0:70]
    d = (y - x) / math.sqrt(2)
    z = 100 - 2 * np.exp(-(d**2) / 18)
    got = stencils.vesselness(surface(spark, z), grid(70, 70), (1, 2, 4), tile=32)
    v, t = array(got, "vesselness", z.shape), array(got, "theta", z.shape)
    inner = np.s_[16:54, 16:54]
    assert np.median(v[inner][np.abs(d[inner]) < 1]) > 0.5
    assert np.median(v[inner][np.abs(d[inner]) > 8]) < 0.05
    # rows count downward: the trough runs from the upper left to the lower right
    assert abs(np.median(t[inner][np.abs(d[inner]) < 1]) - 135) < 1


def test_auc_by_pairs(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 200), rng.integers(0, 20, 200).astype(float)
    s += y
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, y int")
    p, n = s[y == 1], s[y == 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in p for b in n])
    assert math.isclose(learn.auc(df).first().auc, want)
    assert learn.auc(df.filter("y = 1")).first().auc is None


def test_calibration_keeps_what_agrees(spark):
    rng = np.random.default_rng(6)
    rows = []
    for block in ("a", "b"):
        for k in range(400):
            on = k % 2
            rows.append((block, on, float((0.8 if on else 0.2) + rng.normal(0, 0.05)), float(rng.random()), float((on if block == "a" else 1 - on) + rng.normal(0, 0.1))))
    df = spark.createDataFrame(rows, "massif string, presence int, rugosite double, bruit double, tourne double")
    got = {r.canal: r for r in learn.calibrate(learn.channel_areas(df, ["rugosite", "bruit", "tourne"])).collect()}
    assert got["rugosite"].retenu and got["rugosite"].poids == 3 and got["rugosite"].sens == 1
    assert not got["tourne"].retenu and not got["tourne"].stable and got["tourne"].sens is None
    assert got["bruit"].auc < 0.6
    assert set(learn.rules_from(learn.calibrate(learn.channel_areas(df, ["rugosite"])))) == {"rugosite"}


def test_learned_conductivity(spark):
    rng = np.random.default_rng(7)
    rows = [(r, c, c + 0.5, 60 - r - 0.5, float(math.exp(-((r - 30) ** 2) / 8)), float(rng.random())) for r in range(60) for c in range(60)]
    df = spark.createDataFrame(rows, "row int, col int, x double, y double, empreinte double, bruit double")
    line = spark.createDataFrame([(0.0, 29.5, 60.0, 29.5)], "x1 double, y1 double, x2 double, y2 double")
    sample = learn.sample_cells(df, line, ["empreinte", "bruit"], 2.0, 10.0, n_max=400)
    counts = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    assert counts[0] == counts[1] <= 200
    model = learn.learn_conductivity(sample, ["empreinte", "bruit"], k=3)
    assert model.auc_cv > 0.9 and model.prevalence == 0.5 and "AUC" in str(model)
    with pytest.raises(ValueError):
        learn.predict_conductivity(df.drop("bruit"), model)


def test_ranks_and_running_sums(spark):
    from timberline.plans.ranks import hash_rank, running_sum

    df = spark.createDataFrame([(k % 2, k, float(k * 7 % 400)) for k in range(400)], "g int, k int, v double")
    got = hash_rank(df, ["g"], F.xxhash64("k"), "r").collect()
    for g in (0, 1):
        assert sorted(r.r for r in got if r.g == g) == list(range(1, 201))
    for by in ([], ["g"]):
        rows = running_sum(df, by, "v", "k", "s").collect()
        assert all(r.s == sum(o.k for o in rows if o.v <= r.v and (not by or o.g == r.g)) for r in rows)
    sizes = [r["count"] for r in learn.folds(df, "g", "k").groupBy("g", "pli").count().collect()]
    assert set(sizes) == {40} and hash_rank(df.limit(0), ["g"], F.xxhash64("k"), "r").count() == 0


def test_quantiles_without_one_task_for_all(spark, monkeypatch):
    from timberline.plans import ranks

    rng = np.random.default_rng(3)
    a, b = rng.standard_normal(5000), rng.integers(0, 4, 5000).astype(float)
    df = spark.createDataFrame([(float(x), None if y == 3 else float(y), None) for x, y in zip(a, b)], "a double, b double, c double")
    asked = {"a": [0.0, 0.25, 0.5, 0.95, 1.0], "b": [0.5, 0.9], "c": [0.5]}
    want = {"a": np.quantile(a, asked["a"]), "b": np.quantile(b[b != 3], asked["b"])}
    for limit in (200_000, 3):
        monkeypatch.setattr(ranks, "COLLECTED", limit)
        got = ranks.quantiles(df, asked)
        assert np.allclose(got["a"], want["a"]) and np.allclose(got["b"], want["b"]) and got["c"] == [None]


def test_cubic_and_average_resampling(spark):
    from timberline.operators import cells as op

    rng = np.random.default_rng(8)
    z = rng.random((12, 12))
    df = spark.createDataFrame([(r, c, None if (r, c) == (9, 9) else float(z[r, c])) for r in range(12) for c in range(12)], "row int, col int, v double")
    src = {"xmin": 0.0, "ymin": 0.0, "xmax": 12.0, "ymax": 12.0, "res": 1.0, "nrow": 12, "ncol": 12}
    dst = {"xmin": 0.0, "ymin": 0.0, "xmax": 12.0, "ymax": 12.0, "res": 1.5, "nrow": 8, "ncol": 8}
    got = {(r.row, r.col): r.v for r in op.resample_average(df, src, op.grid_cells(spark, dst), dst, "v").collect()}
    fine = np.kron(np.where(np.indices(z.shape).min(0) == 99, 0, z), np.ones((2, 2)))
    fine[18:20, 18:20] = np.nan
    assert len(got) == 64 and all(abs(v - np.nanmean(fine[3 * r : 3 * r + 3, 3 * c : 3 * c + 3])) < 1e-9 for (r, c), v in got.items())
    near = lambda d: (1.5 * d - 2.5) * d * d + 1
    away = lambda d: ((-0.5 * d + 2.5) * d - 4) * d + 2
    k = lambda d: near(abs(d)) if abs(d) <= 1 else away(abs(d)) if abs(d) < 2 else 0.0
    pts = [(3.2, 7.9), (5.5, 5.5), (4.75, 6.25), (0.2, 0.2)]
    out = {(r.x, r.y): r.v for r in op.resample_cubic(df, src, spark.createDataFrame(pts, "x double, y double"), "v").collect()}
    for x, y in pts[:3]:
        fx, fy = x - 0.5, 12 - y - 0.5
        want = sum(k(fx - c) * k(fy - r) * z[r, c] for r in range(12) for c in range(12))
        assert abs(out[x, y] - want) < 1e-9
    assert out[0.2, 0.2] is None and abs(out[5.5, 5.5] - z[6, 5]) < 1e-12


def test_specs_from_sampled_blocks(spark):
    from timberline.operators import learn

    rows = [(r, c, c + 0.5, 60 - r - 0.5, float(10 - abs(r - 30) + (r * 7 + c * 3) % 5), float((r * 31 + c * 17) % 97), float((r + c) % 180)) for r in range(60) for c in range(60)]
    df = spark.createDataFrame(rows, "row int, col int, x double, y double, pente_1 double, bruit double, theta double").withColumn("pente_2", F.col("pente_1") + 1)
    road = spark.createDataFrame([(0.0, 29.5, 60.0, 29.5)], "x1 double, y1 double, x2 double, y2 double")
    got = learn.calibrate_specs([(df, road), (df.filter("col < 40"), road)], n=150)
    by = {r.canal: r for r in got["diagnostic"].collect()}
    assert set(by) == {"pente", "bruit"} and by["pente"].retenu and by["pente"].auc > 0.95 and not by["bruit"].retenu and by["pente"].n_massifs == 2
    assert list(got["specs"]) == ["pente"] and got["specs"]["pente"].kind == "up" and got["terrain"] is None
    assert {r.n_pres for r in got["par_massif"].collect()} == {150}
    with pytest.raises(ValueError):
        learn.calibrate_specs([(df, road)], present=30, absent=20)


def _sampled(spark, frame, how):
    from timberline.operators import blocks, cells

    grid = {"xmin": 5.0, "ymin": 0.0, "xmax": 45.0, "ymax": 30.0, "res": 1.0, "nrow": 30, "ncol": 40}
    rows = [(r, c, float((r * 37 + c * 91) % 101), float(r)) for r in range(30) for c in range(40) if (r * 40 + c) % 17]
    df = spark.createDataFrame(rows, "row int, col int, z double, q double")
    pts = spark.createDataFrame([(k, 4.0 + (k * 7919 % 4300) / 100, -1.0 + (k * 104729 % 3200) / 100, "a") for k in range(400)] + [(400, None, 3.0, "b"), (401, 20.5, 10.5, None)], "id int, x double, y double, row string")
    held = {(r, c): z for r, c, z, _ in rows}

    def plain(x, y):
        if x is None:
            return None
        fx, fy = x - 5.0 - 0.5, 30.0 - y - 0.5
        if how == "nearest":
            return held.get((math.floor(fy + 0.5), math.floor(fx + 0.5)))
        r, c = math.floor(fy), math.floor(fx)
        tx, ty = fx - c, fy - r
        four = [(held.get((r + i, c + j)), (ty if i else 1 - ty) * (tx if j else 1 - tx)) for i in (0, 1) for j in (0, 1)]
        four = [(v, w) for v, w in four if w > 0]
        return None if any(v is None for v, _ in four) else sum(v * w for v, w in four)

    want = {r.id: plain(r.x, r.y) for r in pts.collect()}
    if how == "bilinear":
        got = {r.id: r.v for r in cells.resample_bilinear(df, grid, pts, "z", "v").collect()}
        assert all(got[k] == want[k] if want[k] is None or got[k] is None else abs(got[k] - want[k]) < 1e-9 for k in want)
    for side, points in ((7, 20), (64, 20_000)):
        blocks.POINTS, kept = points, blocks.POINTS
        try:
            got = blocks.sample(blocks.Blocks.of(df, grid, ["z", "q"], side), pts, how, ["z"], ["v"])
            assert got.columns == [*pts.columns, "v"]
            found = {r.id: r.v for r in got.collect()}
        finally:
            blocks.POINTS = kept
        assert set(found) == set(range(402))
        for k in range(402):
            assert found[k] == want[k] if want[k] is None or found[k] is None else abs(found[k] - want[k]) < 1e-9
    return want


def test_blocks_sample_as_joins_do(spark):
    for how in ("bilinear", "nearest"):
        want = _sampled(spark, None, how)
        assert sum(v is not None for v in want.values()) > 150


def test_profiles_take_one_exchange_of_stations(spark):
    from timberline.operators import measure

    grid = {"xmin": 0.0, "ymin": 0.0, "xmax": 40.0, "ymax": 40.0, "res": 1.0, "nrow": 40, "ncol": 40}
    df = spark.createDataFrame([(r, c, 2.0 * c - 3.0 * r) for r in range(40) for c in range(40)], "row int, col int, z double")
    line = spark.createDataFrame([(1, [(12.0, 12.0), (30.0, 24.0)])], "trace_id long, geom array<struct<x:double,y:double>>")
    st = measure.densify(line, 2.0)
    got = measure.cross_profiles(st, df, grid, half=4.0, step=0.5)
    plan = got._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "SortMergeJoin" not in plan
    normal = {r.station: r for r in st.collect()}
    for r in got.collect():
        n = normal[r.station]
        for k, z in enumerate(r.z):
            off = (k - 8) * 0.5
            x, y = r.x - n.nx * off, r.y - n.ny * off
            assert abs(z - (2 * (x - 0.5) - 3 * (40 - y - 0.5))) < 1e-9
