import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.operators import agent, curves, earthworks, measure, pathfind, skeleton, stencils


@pytest.mark.parametrize("p, w, a, b", [(0.3, 4, 1, 0.6), (0.2, 5, 1, 0.8), (0.3, 3, 1.5, 0.5), (0.1, 6, 0.67, 0.6)])
def test_earthworks_on_a_plane(p, w, a, b):
    off = np.arange(-2000, 2001) * 0.01
    s = earthworks.earthwork_section(off, p * off, w, a, b)
    half = p * w / 2
    assert math.isclose(s["section_deblai"], p * w * w / 8 + 0.5 * half**2 / (a - p), rel_tol=0.01)
    assert math.isclose(s["section_remblai"], p * w * w / 8 + 0.5 * half**2 / (b - p), rel_tol=0.01)


def road(off, width, shoulder, bank=0.6):
    x = np.abs(off)
    z = np.where(x > width / 2, -(np.minimum(x, width / 2 + shoulder) - width / 2) * 0.06, 0.0)
    return np.where(x > width / 2 + shoulder, z - (x - width / 2 - shoulder) * bank, z)


@pytest.mark.parametrize("width", [3, 4, 5])
def test_carriageway_within_platform(width):
    off = np.arange(-80, 81) * 0.1
    got = measure.read_profile(road(off, width, 1.0), off)
    assert abs(got["LARGEUR_ROULABLE"] - width) < 0.15 and got["BORDS_CHAUSSEE"] == 2
    assert math.isclose(got["BORD_G"] + got["BORD_D"], got["LARGEUR_ROULABLE"])
    assert measure.flat_width(road(off, 4, 1.0), off)["width"] > 5
    coarse = np.arange(-16, 17) * 0.5
    bare = measure.read_profile(road(coarse, width, 0.0), coarse)
    assert bare["BORDS_CHAUSSEE"] == 0 and bare["LARGEUR_ROULABLE"] == measure.flat_width(measure.moving_mean(road(coarse, width, 0.0), 3), coarse)["width"]


def test_ditches_left_and_both():
    off = np.arange(-32, 33) * 0.25
    x = off.copy()
    hill = np.where(np.abs(x) <= 2, 0.0, np.where(x < 0, (np.abs(x) - 2) * 0.6, -(x - 2) * 0.6))
    left = np.where((x < -2) & (x > -3.5), -0.5, hill)
    both = np.where((np.abs(x) > 2) & (np.abs(x) < 3.5), -0.5, np.where(np.abs(x) >= 3.5, (np.abs(x) - 3) * 0.6, 0.0))
    assert measure.read_profile(left, off, "planeite")["FOSSES"] == 1
    assert measure.read_profile(both, off, "planeite")["FOSSES"] == 2
    assert measure.read_profile(hill, off, "planeite")["FOSSES"] == 0


def test_path_keeps_to_the_conduit_and_out_of_walls():
    s = np.full((40, 40), 0.08)
    s[20] = 0.95
    _, path = pathfind.least_cost(s, (20, 2), (20, 37))
    assert max(abs(r - 20) for r, _ in path) <= 2
    s[:, 15] = np.nan
    assert pathfind.least_cost(s, (20, 2), (20, 37))[1] is None


def test_cost_field_and_length():
    s = np.full((30, 30), 1.0)
    cost, _ = pathfind.least_cost(s, (15, 15), None, res=2.0, turning=0.0)
    assert np.isfinite(cost).all() and cost[15, 15] == 0 and math.isclose(cost[15, 20], 10)
    _, path = pathfind.least_cost(np.full((30, 30), 0.7), (0, 0), (29, 29))
    assert sum(math.dist(a, b) for a, b in zip(path, path[1:])) / math.dist((0, 0), (29, 29)) < 1.05


def test_reposition_moves_a_little_and_keeps_rows(spark):
    rows = [(r, c, c + 0.5, 60 - r - 0.5, 0.95 if r == 25 else 0.2) for r in range(60) for c in range(60)]
    cells = spark.createDataFrame(rows, "row int, col int, x double, y double, sigma double")
    g = {"xmin": 0.0, "ymin": 0.0, "xmax": 60.0, "ymax": 60.0, "res": 1.0, "nrow": 60, "ncol": 60}
    seg = spark.createDataFrame([(1, 5.0, 31.0, 55.0, 31.0), (2, 500.0, 500.0, 510.0, 500.0)], "id long, x1 double, y1 double, x2 double, y2 double")
    got = {r.id: r for r in pathfind.reposition(seg, cells, g).collect()}
    assert got[1].RECALE and 0 < got[1].DEPLACEMENT_MAX <= 10 and not got[2].RECALE and len(got[2].geom) == 2 and got[2].DEPLACEMENT_MAX is None
    # a polyline with a bend that its ends know nothing of: the corridor follows it
    bent = [{"x": 5.0, "y": 35.0}, {"x": 30.0, "y": 12.0}, {"x": 55.0, "y": 35.0}]
    line = spark.createDataFrame([(3, bent)], "id long, geom array<struct<x:double,y:double>>")
    flat = cells.withColumn("sigma", F.lit(0.8))
    moved = pathfind.reposition(line, flat, g, deviation=6.0).collect()[0]
    assert moved.RECALE and min(p.y for p in moved.geom) < 20 and moved.DEPLACEMENT_MAX <= 6 and (moved.geom[0].x, moved.geom[-1].x) == (5.0, 55.0)


def road_map(gap=None):
    n = 100
    y = 199 - 2 * np.arange(n)
    s = np.full((n, n), 0.1)
    s[np.abs(y - 100) < 4] = 1
    if gap:
        s[:, gap[0] // 2 : gap[1] // 2] = 0.1
    return agent.Ground(s, 0, 200, 2.0)


SEED = np.array([[10.0, 100.0], [25.0, 100.0]])


def test_driver_follows_crosses_and_gives_up():
    d = agent.drive(road_map(), SEED, reach=40)
    assert d["why"] == "hors_emprise" and d["route"][-1][0] > 185 and np.abs(d["route"][:, 1] - 100).max() < 2
    assert agent.drive(road_map((90, 110)), SEED, reach=40)["route"][:, 0].max() > 180
    d = agent.drive(road_map((90, 200)), SEED, reach=40)
    assert d["why"] == "trouee_trop_longue" and d["route"][:, 0].max() < 110


def test_driver_stops_at_the_network():
    d = agent.drive(road_map(), SEED, [np.array([[150.0, 0.0], [150.0, 200.0]])], reach=40)
    assert d["why"] == "reseau_rejoint" and 125 < d["route"][:, 0].max() < 145


def test_rounds_do_not_depend_on_order_or_tiles(spark):
    g = {"xmin": 0.0, "ymin": 0.0, "xmax": 300.0, "ymax": 100.0, "res": 2.0, "nrow": 50, "ncol": 150}
    bent = lambda c: 25 + round(6 * math.sin(c / 30))
    rows = [(r, c, 2 * c + 1.0, 99.0 - 2 * r, 0.9 if abs(r - bent(c)) <= 1 or (abs(c - 70) <= 1 and r < 25) else 0.1) for r in range(50) for c in range(150) if not 130 < 10 * r + c < 135]
    cells = spark.createDataFrame(rows, "row int, col int, x double, y double, p double")
    run = lambda df, tile: sorted((r.why, [(p.x, p.y) for p in r.geom]) for r in agent.vectorise(df, g, rounds=2, reach=20.0, buffer=5.0, tile=tile, halo=20).collect())
    one = run(cells, 512)
    assert one and max(max(x for x, _ in geom) - min(x for x, _ in geom) for _, geom in one) > 150  # over several tiles
    assert one == run(cells.repartition(7, "col"), 512) == run(cells, 40)
    with pytest.raises(ValueError):
        agent.vectorise(cells, g, reach=100.0, halo=20)


def test_fan_looks_straight_ahead_and_to_both_sides():
    for reach in (25, 40, 100, 6.25):
        a = agent.fan(reach, 160, 1.0)
        assert np.allclose(a, -a[::-1]) and 0 in a and abs(a[-1]) <= math.radians(80) + 1e-9


def test_troughs_of_a_fan():
    cost = np.full(41, 500.0)
    cost[8:13], cost[30:33] = 60.0, 300.0
    got = agent.directions(cost, 100.0)
    assert [k for k, _ in got][:1] == [8] and math.isclose(got[0][1], 60 / 250) and all(r <= 1 for _, r in got)
    assert agent.directions(np.full(41, np.inf), 100.0) == [] == agent.directions(cost[:5], 100.0)
    one = agent.directions(cost * 100, 100.0)
    assert len(one) == 1 and one[0][1] > 1


def test_lines_side_by_side_are_kept_once_wherever_they_begin(spark):
    line = lambda x, y, n: [{"x": float(x + 10 * k), "y": float(y)} for k in range(n)]
    rows = [(0, "a", line(3990, 100, 30)), (0, "b", line(4010, 102, 20)), (0, "c", line(4010, 200, 5)), (0, "d", line(4010, 100, 10) + line(4110, 140, 10))]
    df = spark.createDataFrame(rows, "round int, why string, geom array<struct<x: double, y: double>>")
    assert sorted(r.why for r in agent._apart(df, 10.0).collect()) == ["a", "c", "d"]


def test_curves():
    t = np.radians(np.linspace(-45, 45, 400))
    arc = 60 * np.stack([np.cos(t), np.sin(t)], axis=1)
    stairs = np.unique(np.round(arc), axis=0)
    stairs = stairs[np.argsort(np.arctan2(stairs[:, 1], stairs[:, 0]))]
    true = 60 * math.pi / 2
    assert curves.length(stairs) > 1.2 * true
    for got in (curves.savitzky_golay(stairs, 15), curves.bezier_smooth(stairs, 2.0, 1.0)):
        assert abs(curves.length(got) / true - 1) < 0.03 and np.allclose(got[0], stairs[0]) and np.allclose(got[-1], stairs[-1])
    line = np.stack([np.arange(30.0), 2 * np.arange(30.0)], axis=1)
    assert np.abs(curves.savitzky_golay(line, 7) - line).max() < 1e-9
    assert len(curves.simplify(line, 0.1)) == 2
    joined = curves.join_ends([np.array([[0.0, 0], [5, 0], [10, 0]]), np.array([[12.0, 0], [16, 0], [20, 0]])], 5)
    assert len(joined) == 1 and np.allclose(joined[0][[0, -1], 0], [0, 20])


def test_skeleton_of_a_tee():
    m = np.zeros((40, 80), bool)
    m[18:23, 5:75] = True
    m[20:39, 38:43] = True
    assert len(skeleton.chains(stencils.thin(m))) == 3


def test_patches_and_straight_lines(spark):
    g = {"xmin": 0.0, "ymin": 0.0, "xmax": 90.0, "ymax": 90.0, "res": 1.0, "nrow": 90, "ncol": 90}
    rows = [(r, c) for r in (10, 11) for c in range(5, 75)] + [(50 + k, 10 + k) for k in range(30)]
    df = spark.createDataFrame(rows, "row int, col int")
    assert skeleton.patches(df, 90).select("patch").distinct().count() == 2
    got = skeleton.straight_lines(df, g, 20.0).collect()
    assert len(got) == 2 and all(len(r.geom) >= 2 for r in got)


@pytest.mark.parametrize("headings, turning", [(16, 2.0), (1, 0.0)])
def test_sparse_search_equals_the_search_in_a_box(headings, turning):
    rng = np.random.default_rng(headings)
    for _ in range(6):
        n, m = rng.integers(12, 34, 2)
        s = rng.random((n, m))
        s[rng.random((n, m)) < 0.2] = np.nan
        theta, weight = rng.random((n, m)) * 180, rng.random((n, m)) * (rng.random((n, m)) < 0.7)
        theta[rng.random((n, m)) < 0.1] = np.nan
        r, c = np.nonzero(~np.isnan(s))
        a, b = ((int(r[k]), int(c[k])) for k in rng.choice(len(r), 2, replace=False))
        cost, path = pathfind.least_cost(s, a, None, theta, weight, headings, 4.0, turning)
        g = pathfind.Ground(np.zeros(len(r)), r, c, s[r, c], theta[r, c], weight[r, c], headings, 4.0, turning)
        dist, free, at = g.labels(), np.zeros(len(r), bool), g.place([0], [a[0]], [a[1]])
        free[at] = True
        first = np.unique((at[:, None] * headings + np.arange(headings)).ravel())
        dist[first] = 0
        g.correct(dist, first, free)
        want = np.where(np.isnan(cost), np.inf, cost)[g.row, g.col]
        assert np.array_equal(dist.reshape(-1, headings).min(axis=1), want)
        found = pathfind.sparse_paths(g, at, g.place([0], [b[0]], [b[1]]))[0]
        assert (found is None) == np.isnan(cost[b])
        if found:
            assert (g.row[found[0]], g.col[found[0]]) == a and (g.row[found[-1]], g.col[found[-1]]) == b


def test_five_kilometres_fit_in_the_cells_of_their_corridor():
    """A diagonal whose box would have 25 million cells and 16 headings each."""
    along = np.arange(5000)
    r, c = (np.concatenate(x) for x in zip(*[(along, along + d) for d in range(-10, 11)]))
    r, c = r[c >= 0], c[c >= 0]
    tracemalloc.start()
    g = pathfind.Ground(np.zeros(len(r)), r, c, np.where(r == c, 0.9, 0.2))
    path = pathfind.sparse_paths(g, g.place([0], [3], [3]), g.place([0], [4990], [4990]))[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4e8 and len(path) == 4988 and (g.row[path] == g.col[path]).all()


def test_areas_are_searched_side_by_side_and_apart():
    rng = np.random.default_rng(7)
    grids = [rng.random((15, 18)) for _ in range(5)]
    cells = [(k, i, j, s[i, j]) for k, s in enumerate(grids) for i in range(15) for j in range(18) if s[i, j] > 0.15]
    area, r, c, v = (np.array(x) for x in zip(*cells))
    g = pathfind.Ground(area, r, c, v)
    starts, goals = (np.array([int(g.place([k], [i], [j])[0]) for k, i, j in ends]) for ends in ([(k, 2 + k, 1) for k in range(5)], [(k, 12, 15 - k) for k in range(5)]))
    for k, path in enumerate(pathfind.sparse_paths(g, starts, goals)):
        one = pathfind.Ground(np.zeros((area == k).sum()), r[area == k], c[area == k], v[area == k])
        alone = pathfind.sparse_paths(one, one.place([0], [2 + k], [1]), one.place([0], [12], [15 - k]))[0]
        assert (path is None) == (alone is None)
        if path:
            assert [(g.row[p], g.col[p]) for p in path] == [(one.row[p], one.col[p]) for p in alone]


@pytest.mark.parametrize("tile", [7, 16, 64])
def test_cost_field_over_tiles(spark, tile):
    rng = np.random.default_rng(3)
    s = rng.random((40, 33))
    s[rng.random(s.shape) < 0.15] = np.nan
    s[20, :28] = np.nan  # a wall that paths must go around, through several tiles
    starts = [(2, 3), (35, 30)]
    s[2, 3] = s[35, 30] = 0.5
    rows = [(i, j, float(s[i, j]), float(10 * i % 180), 0.4) for i in range(40) for j in range(33)]
    df = spark.createDataFrame(rows, "row int, col int, sigma double, theta double, poids double")
    got = pathfind.cost_field(df, spark.createDataFrame(starts, "row int, col int"), tile=tile, res=2.0)
    theta, weight = (10.0 * np.arange(40) % 180)[:, None] + np.zeros(33), np.full(s.shape, 0.4)
    each = [pathfind.least_cost(s, a, None, theta, weight, res=2.0)[0] for a in starts]
    want = np.fmin(*each)
    found = {(r.row, r.col): r.cost for r in got.collect()}
    assert set(found) == set(map(tuple, np.argwhere(~np.isnan(want)).tolist()))
    assert all(found[k] == want[k] for k in found)


def test_cost_field_without_cells_or_starts(spark):
    one, none = spark.createDataFrame([(0, 0, 1.0)], "row int, col int, sigma double"), spark.createDataFrame([], "row int, col int")
    assert pathfind.cost_field(one, none).count() == 0
    assert pathfind.cost_field(one.limit(0), one.select("row", "col")).count() == 0
    assert [tuple(r) for r in pathfind.cost_field(one, one.select("row", "col")).collect()] == [(0, 0, 0.0)]


def test_weights_do_not_depend_on_the_block():
    from timberline.operators.blocks import bilinear

    rng = np.random.default_rng(3)
    a, fy, fx = rng.random((40, 40)), rng.random(5000) * 8 + 20, rng.random(5000) * 8 + 20
    assert (bilinear(a, fy, fx) == bilinear(a[13:, 11:], fy, fx, 13, 11)).all()


def test_large_doubles_round_as_in_duckdb(spark):
    import duckdb

    from timberline.queries import rounded_double

    values = [7609624449125.756, 976976156052.9061, 3985461612938.329, 233218047730.79514, 1.00035, 0.00005, 12.34565, -3.21455]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", rounded_double("v", 4).alias("g")).orderBy("i").collect()
    assert [r.g for r in got] == [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 4)", [v]).fetchall()[0][0] for v in values]


def test_equal_traces_are_measured_once(spark):
    from timberline.queries import _once

    rows = [(k, [(float(k % 3), 1.0), (5.0, float(k % 2))]) for k in range(12)] + [(20, [])]
    once, all_ = _once(spark.createDataFrame(rows, "trace_id long, geom array<struct<x:double,y:double>>"))
    assert sorted(r.trace_id for r in once.collect()) == [0, 1, 2, 3, 4, 5, 20]
    assert {r.trace_id: r["__first"] for r in all_.collect()} == {**{k: k % 6 for k in range(12)}, 20: 20}
