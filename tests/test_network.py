import math
import random

import numpy as np

from timberline.operators import classify, network, norms
from timberline.plans.components import connected_components
from tests import plain

SEG = "id long, x1 double, y1 double, x2 double, y2 double"


def test_components_of_chain_star_loop_and_nothing(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 160)]
    df = spark.createDataFrame([*chain, *star, (500, 500), (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 160)) and got[500] == 500 and len(got) == 102
    assert connected_components(df.limit(0)).count() == 0


def test_snapping_is_idempotent(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (2, 10.3, 0.2, 20.0, 0.0)], SEG)
    once = {r.id: r for r in network.snap_nodes(df).collect()}
    assert (once[1].x2, once[1].y2) == (once[2].x1, once[2].y1)
    twice = {r.id: r for r in network.snap_nodes(spark.createDataFrame(list(once.values()), SEG)).collect()}
    assert all(math.isclose(once[1][k], twice[1][k]) for k in ("x1", "y1", "x2", "y2"))


def test_parallel_lines(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 20.0, 0.0), (2, 0.0, 1.0, 19.0, 1.1), (3, 0.0, 50.0, 20.0, 50.0)], SEG)
    assert sorted(r.id for r in network.dedupe_parallels(df).collect()) == [1, 3]


def test_components_and_public_roads(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (2, 10.3, 0.2, 20.0, 0.0), (3, 50.0, 50.0, 60.0, 60.0), (4, 60.0, 60.0, 70.0, 50.0)], SEG)
    public = spark.createDataFrame([(-5.0, 0.0, 0.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")
    edges, nodes = network.network(network.snap_nodes(df), public)
    s = network.network_summary(edges, nodes).first()
    assert (s.n_aretes, s.n_composants, s.n_noeuds) == (4, 2, 6) and s.longueur_deconnectee > 28
    assert {r.id: r.connecte_public for r in edges.collect()} == {1: True, 2: True, 3: False, 4: False}


def test_comb_of_four(spark):
    rows = [(k, 0.0, 20.0 * k, 100.0, 20.0 * k) for k in range(4)] + [(9, 300.0, 0.0, 300.0, 80.0)]
    got = {r.id: r for r in network.combs(spark.createDataFrame(rows, SEG)).collect()}
    assert all(got[k].PEIGNE_N == 4 and math.isclose(got[k].PEIGNE_ESPACEMENT, 20) for k in range(4)) and got[9].PEIGNE is None


def test_query_keeps_a_comb_across_500_m(spark, monkeypatch):
    from timberline import queries

    rows = [(k, 100.0, 450.0 + 20.0 * k, 200.0, 450.0 + 20.0 * k) for k in range(6)]
    segments = spark.createDataFrame(rows, SEG)
    monkeypatch.setattr(queries, "load", lambda *a: [segments])
    got = {(r.PEIGNE, r.PEIGNE_N) for r in queries.parallel_combs(spark, "").collect()}
    assert got == {(0, 6)}


def test_combs_of_many_lines_by_one_scan(spark):
    rng = random.Random(4)
    rows, at = [], 0.0
    for k in range(900):
        at += rng.choice([0.0, 2.0, 10.0, 11.0, 12.0, 12.0, 30.0, 60.0])
        rows.append((k, 0.0, at, 100.0, at))
    rows += [(2000 + k, 50.0 + 10 * k, 0.0, 50.0 + 10 * k, 30.0) for k in range(4)]
    want, off = {}, np.array([r[2] for r in rows[:900]])
    gaps = np.diff(off)
    for a, b in network.regular_runs(gaps, 4.0, 40.0, 0.5):
        if b - a >= 2:
            want.update((t, (b - a + 1, a, float(np.median(gaps[a:b])))) for t in range(a, b + 1))
    want.update((2000 + k, (4, 2000, 10.0)) for k in range(4))
    rng.shuffle(rows)
    got = {r.id: r for r in network.combs(spark.createDataFrame(rows, SEG)).collect()}
    assert len(got) == 904 and {k: (r.PEIGNE_N, r.PEIGNE) for k, r in got.items() if r.PEIGNE is not None} == {k: v[:2] for k, v in want.items()}
    assert all(math.isclose(got[k].PEIGNE_ESPACEMENT, v[2], abs_tol=1e-6) for k, v in want.items())


def test_directions_meet_across_180(spark):
    rows = [(1, 0.0, 0.0, 100.0, 1.0), (2, 0.0, 20.0, 100.0, 19.0), (3, 0.0, 40.0, 100.0, 41.0)]
    assert all(r.PEIGNE_N == 3 for r in network.combs(spark.createDataFrame(rows, SEG)).collect())


def test_signs(spark):
    rows = [(k, 0.0, 20.0 * k, 100.0, 20.0 * k) for k in range(4)]
    edges = classify.classify(spark.createDataFrame(rows, SEG))
    one = spark.createDataFrame([("private", None, 50.0, 0.0)], "access string, source string, x double, y double")
    got = {r.id: r for r in classify.attested_access(edges, one).collect()}
    assert got[0].OSM_TAGS == "access=private;source:access=survey" and got[3].OSM_TAGS is None
    two = one.union(spark.createDataFrame([("yes", None, 51.0, 0.0)], one.schema))
    assert {r.id: r.OSM_TAGS for r in classify.attested_access(edges, two).collect()}[0] is None


def test_norm_of_both_schemas(spark):
    v2 = spark.createDataFrame([("Autre", "Chemin", "NC", 0), ("Autre", "Route empierrée", "NC", 0), ("Départementale", "Route à 1 chaussée", "NC", 1), ("?", "?", None, None)],
                               "cl_admin string, nature string, franchisst string, nb_voies int")
    got = norms.normative_widths(v2)
    assert [r.LARGEUR_CHAUSSEE_CERTU for r in got.collect()] == [2, 2, 3, None]
    v3 = spark.createDataFrame([("Autre", "Route à 1 chaussée", 1, "1")], "CPX_CLASSEMENT_ADMINISTRATIF string, NATURE string, NOMBRE_DE_VOIES int, POS_SOL string")
    assert norms.normative_widths(v3).first().BERME_CERTU == 0


def test_tiles_of_a_corridor(spark):
    tiles = spark.createDataFrame([(1000.0 * a, 1000.0 * b, 1000.0 * a + 1000, 1000.0 * b + 1000) for a in range(3) for b in range(3)], "xmin double, ymin double, xmax double, ymax double")
    line = spark.createDataFrame([(100.0, 980.0, 900.0, 980.0)], "x1 double, y1 double, x2 double, y2 double")
    assert sorted((r.xmin, r.ymin) for r in network.tiles_required(tiles, line).collect()) == [(0.0, 0.0), (0.0, 1000.0)]


def test_reconnecting_ends(spark):
    line = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    rows = [(1, line((0, 0), (5, 0), (10, 0))), (2, line((12, 0), (16, 0), (20, 0))), (3, line((12, 4), (12, 10))), (4, line((500, 0), (600, 0)))]
    got = {r.id: r.geom for r in network.reconnect(spark.createDataFrame(rows, "id long, geom array<struct<x:double,y:double>>"), 5.0).collect()}
    assert set(got) == {1, 3, 4} and sorted((got[1][0].x, got[1][-1].x)) == [0.0, 20.0] and len(got[1]) == 6


def test_polylines_and_networks_that_hang_together(spark):
    g = "id long, geom array<struct<x:double,y:double>>"
    rows = [(1, [(0.0, 0.0), (50.0, 0.0), (50.0, 50.0)]), (2, [(0.0, 1.0), (48.0, 1.0)]), (3, [(50.0, 50.0), (90.0, 50.0)]), (4, [(50.0, 50.0), (50.0, 0.0), (0.0, 0.0)])]
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in p]) for i, p in rows], g)
    assert sorted(r.id for r in network.dedupe_parallels(df, 3.0).collect()) == [1, 3]  # 4 is 1 the other way round
    edges, nodes = network.network(df)
    assert {r.id: round(r.longueur) for r in edges.collect()} == {1: 100, 2: 48, 3: 40, 4: 100} and nodes.count() == 5
    # a connected grid: nothing runs beside anything, nothing goes, and no step holds the grid in one group
    n = 24
    mesh = [(2 * (n * i + j), 10.0 * i, 10.0 * j, 10.0 * i + 10, 10.0 * j) for i in range(n) for j in range(n)] + [(2 * (n * i + j) + 1, 10.0 * i, 10.0 * j, 10.0 * i, 10.0 * j + 10) for i in range(n) for j in range(n)]
    assert network.dedupe_parallels(spark.createDataFrame(mesh, "id long, x1 double, y1 double, x2 double, y2 double"), 3.0).count() == len(mesh)


def test_greedy_cover_by_a_plain_choice(spark):
    rng = np.random.default_rng(6)
    rows = [(k, float(rng.integers(0, 60)), float(rng.integers(0, 3)), float(rng.integers(5, 40))) for k in range(120)]
    segs = [(k, x, y, x + n, y + float(rng.integers(0, 2))) for k, x, y, n in rows]
    got = sorted(r.id for r in network.dedupe_parallels(spark.createDataFrame(segs, "id long, x1 double, y1 double, x2 double, y2 double"), 3.0).collect())
    kept = []
    for k, a, b, c, d in sorted(segs, key=lambda s: (-math.hypot(s[3] - s[1], s[4] - s[2]), s[0])):
        found = [i for o in kept if (i := plain.capsule_interval((a, b), (c, d), (o[1], o[2]), (o[3], o[4]), 1.5))]
        if network.covered(found) < 0.7:
            kept.append((k, a, b, c, d))
    assert got == sorted(k[0] for k in kept)


def test_reconnecting_takes_the_nearest_first_and_closes_no_ring(spark):
    from timberline.operators.curves import as_array, join_ends

    rng = np.random.default_rng(12)
    lines = []
    for k in range(60):
        x, y, a = rng.random() * 120, rng.random() * 120, rng.random() * 2 * math.pi
        lines.append(np.array([[x + t * math.cos(a), y + t * math.sin(a)] for t in (0.0, 4.0, 8.0, 12.0)]))
    r = 20 / math.sqrt(3)
    for k in range(3):  # a triangle with gaps at its corners
        p, q = (np.array([300 + r * math.cos(t), 300 + r * math.sin(t)]) for t in (2.1 * k, 2.1 * (k + 1)))
        lines.append(np.array([p + t * (q - p) for t in (0.1, 0.4, 0.6, 0.9)]))
    df = spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in xy]) for k, xy in enumerate(lines)], "id long, geom array<struct<x:double,y:double>>")
    form = lambda xy: min(str(np.round(xy, 6).tolist()), str(np.round(xy[::-1], 6).tolist()))
    got = sorted(form(as_array(r.geom)) for r in network.reconnect(df, 9.0, 70.0).collect())
    want = join_ends(lines, 9.0, 70.0)
    assert len(want) < len(lines) and got == sorted(form(x) for x in want)


def test_points_in_polygons(spark):
    from timberline.operators.cells import inside

    ring = [(0.0, 0.0), (30.0, 0.0), (30.0, 30.0), (15.0, 10.0), (0.0, 30.0)]
    poly = spark.createDataFrame([([{"x": x, "y": y} for x, y in ring],)], "geom array<struct<x:double,y:double>>")
    pts = [(2.5 * k + 0.1, 2.5 * j + 0.2) for k in range(-2, 15) for j in range(-2, 15)]
    got = {(r.x, r.y) for r in inside(spark.createDataFrame(pts, "x double, y double"), poly, 7.0).collect()}

    def plain(x, y):
        hit = False
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
            hit ^= (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a
        return hit

    assert got == {p for p in pts if plain(*p)} and len(got) > 50


def _scattered(spark, n, m, seed):
    """Points and segments, dense at one end of the land and sparse at the other, some twice and some without length, as tables."""
    from timberline.session import materialize

    rng = random.Random(seed)
    xy = lambda: (rng.random() ** 3 * 400 - 20, rng.random() * 60)
    pts = [(k, *xy()) for k in range(n)]
    segs = []
    for k in range(m):
        x, y = xy()
        segs.append((k, x, y, x + rng.choice([0, rng.uniform(-30, 30)]), y if rng.random() < 0.3 else y + rng.uniform(-30, 30)))
    segs += [(m + k, *segs[k][1:]) for k in range(0, m, 3)]
    return pts, segs, materialize(spark.createDataFrame(pts, "pid long, x double, y double")), materialize(spark.createDataFrame(segs, SEG))


def _gap(x, y, x1, y1, x2, y2):
    size = (x2 - x1) ** 2 + (y2 - y1) ** 2
    t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / size)) if size > 0 else 0.0
    return math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1))


def _joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_segments_without_broadcast_of_lists(spark):
    from timberline.operators.cells import near_segments

    pts, segs, p, s = _scattered(spark, 300, 120, 5)
    for reach in (0.7, 4.0, 30.0):
        got = near_segments(p.select("x", "y"), s, reach)
        want = {(x, y) for _, x, y in pts if min(_gap(x, y, *g[1:]) for g in segs) <= reach}
        assert {(r.x, r.y) for r in got.collect()} == want and 0 < len(want)
        assert "Join" in _joins(got) and "BroadcastHashJoin" not in _joins(got).replace("BroadcastHashJoin [__gx", "")


def test_nearest_feature_by_growing_reach(spark):
    pts, segs, p, s = _scattered(spark, 300, 120, 6)
    for reach in (2.0, 50.0):
        got = network.nearest_feature(p, s, reach, ["id"])
        assert "BroadcastHashJoin" not in _joins(got)
        near = {k: min((_gap(x, y, *g[1:]), g[0]) for g in segs) for k, x, y in pts}
        want = {k: i for k, (d, i) in near.items() if d <= reach}
        rows = got.collect()
        assert {r.pid: r.id for r in rows} == want and len(rows) == len(want) and all(abs(r.d - near[r.pid][0]) < 1e-9 for r in rows)
    assert network.nearest_feature(p, s.limit(0), 5.0, ["id"]).count() == 0


def test_parallels_by_tiles_equal_a_plain_choice(spark, monkeypatch):
    from timberline.operators import parallels

    rng = np.random.default_rng(8)
    segs = [(k, float(rng.integers(0, 160)), float(rng.integers(0, 160)), float(rng.integers(-25, 26)), float(rng.integers(1, 26))) for k in range(900)]
    segs = [(k, x, y, x + dx, y + dy) for k, x, y, dx, dy in segs] + [(2000 + k, 40.0, 40.0 + k / 8, 60.0, 40.0 + k / 8) for k in range(200)]
    segs += [(3000, -400.0, 80.0, 900.0, 81.0)] + [(3001 + k, 3.0 * k, 80.0, 3.0 * k + 0.5, 80.0) for k in range(40)]
    kept = []
    for k, *c in sorted(segs, key=lambda s: (-math.hypot(s[3] - s[1], s[4] - s[2]), s[0])):
        near = [o for o in kept if all(min(c[i], c[i + 2]) - 1.5 <= max(o[i + 1], o[i + 3]) and min(o[i + 1], o[i + 3]) - 1.5 <= max(c[i], c[i + 2]) for i in (0, 1))]
        found = [i for o in near if (i := plain.capsule_interval(tuple(c[:2]), tuple(c[2:]), tuple(o[1:3]), tuple(o[3:]), 1.5))]
        if network.covered(found) < 0.7:
            kept.append((k, *c))
    df = spark.createDataFrame(segs, SEG)
    rounds = []
    view = parallels._view
    monkeypatch.setattr(parallels, "_view", lambda *a: rounds.append(1) or view(*a))
    for side, halo, blur, octave in ((10.0, 2.5, 64, 64.0), (1.0, 0.7, 64, 4.0), (1.0, 0.7, 2, 64.0)):
        for name, v in (("SIDE", side), ("HALO", halo), ("BLUR", blur), ("OCTAVE", octave)):
            monkeypatch.setattr(parallels, name, v)
        rounds.clear()
        assert sorted(r.id for r in network.dedupe_parallels(df, 3.0).collect()) == sorted(k[0] for k in kept)
        assert len(rounds) <= 8


def test_covered_pieces_by_arrays_equal_a_search():
    from timberline.operators import parallels

    rng = np.random.default_rng(3)
    p, q = rng.integers(0, 12, (400, 4)).astype(float), rng.integers(0, 12, (400, 4)).astype(float)
    lo, hi, ok = parallels.capsule_parts(p, q, 1.5)
    for k in range(400):
        want = plain.capsule_interval(tuple(p[k, :2]), tuple(p[k, 2:]), tuple(q[k, :2]), tuple(q[k, 2:]), 1.5) if (p[k, :2] != p[k, 2:]).any() else None
        if want and want[1] - want[0] > 1e-9:
            assert ok[k] and np.allclose([lo[k], hi[k]], want, atol=1e-9)


def test_snapping_over_blocks_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, *(float(v) for v in rng.integers(-40, 40, 4) + rng.integers(0, 2, 4) / 4)) for k in range(260)]
    rows += [(300 + k, 3.0 * k - 150, 60.0, 3.0 * k - 150, 70.0) for k in range(100)]  # a chain over many blocks
    rows += [(900, 500.0, 500.0, 500.0, 500.0), (901, 500.0, 500.0, 502.0, 500.0), (902, None, 1.0, 5e3, 5e3)]
    pts = [(2 * i + e, *(c[2 * e : 2 * e + 2])) for i, *c in rows for e in (0, 1) if c[2 * e] is not None]
    top = {p: p for p, _, _ in pts}

    def find(p):
        while top[p] != p:
            p = top[p]
        return p

    for k, (p, x, y) in enumerate(pts):
        for q, u, v in pts[:k]:
            if math.sqrt((x - u) * (x - u) + (y - v) * (y - v)) <= 3.0:
                a, b = find(p), find(q)
                top[max(a, b)] = min(a, b)
    groups = {}
    for p, x, y in pts:
        groups.setdefault(find(p), []).append((x, y))
    centre = {g: (sum(x for x, _ in v) / len(v), sum(y for _, y in v) / len(v)) for g, v in groups.items()}
    assert len(groups) > 5
    df = spark.createDataFrame(rows, SEG)
    sizes, parts = [], network.connected_components
    monkeypatch.setattr(network, "connected_components", lambda e: sizes.append(e.distinct().count()) or parts(e))
    for block in (network.BLOCK, 4):
        monkeypatch.setattr(network, "BLOCK", block)
        got = {r.id: r for r in network.snap_nodes(df, 3.0).collect()}
        assert len(got) == len(rows) and (got[902].x1, got[902].y1) == (None, 1.0)
        for i, *c in rows:
            for e in (0, 1):
                if c[2 * e] is not None:
                    assert np.allclose((got[i][1 + 2 * e], got[i][2 + 2 * e]), centre[find(2 * i + e)], atol=1e-9)
    assert sizes[0] < 40  # one row for each tie between blocks, none for points
    assert {r.pid: r.cluster for r in network.clusters(spark.createDataFrame(pts, "pid long, x double, y double"), 3.0).collect()} == {p: find(p) for p, _, _ in pts}
