"""Skeletons by tiles against the plain way over the whole mask."""

import numpy as np
import pytest

from timberline.operators import skeleton, stencils


def masks():
    rng = np.random.default_rng(1)
    roads = np.zeros((50, 60), bool)
    for _ in range(9):
        r, c, w = rng.integers(0, 50), rng.integers(0, 60), rng.integers(1, 5)
        roads[r : r + w] |= rng.random(60) < 0.97
        roads[:, c : c + w] |= (rng.random(50) < 0.97)[:, None]
    y, x = np.mgrid[:70, :45]
    far = np.hypot(y - 35, x - 22)
    rings = (abs(far - 9) < 2) | (abs(far - 16) < 1) | (rng.random((70, 45)) < 0.2)
    alone = abs(far - 14) < 2.5  # a ring without a node, through several tiles
    return {"roads": roads, "rings": rings, "alone": alone}


def frame(spark, mask):
    rows = [(int(r), int(c), "x") for r, c in np.argwhere(mask)]
    return spark.createDataFrame(rows + rows[:3] + [(None, 1, "x")], "row int, col int, patch string")


def plain(mask, prune):
    paths = [[tuple(c) for c in p.tolist()] for p in skeleton.chains(stencils.thin(mask), prune)]
    cells = {c for p in paths for c in p}
    ring = lambda p: p[0] == p[-1] and len(p) > 3 and len(skeleton.around(cells, p[0])) == 2
    return sorted(skeleton._in_order(p, ring(p)) for p in paths)


@pytest.mark.parametrize("name, tile", [("roads", 16), ("rings", 11), ("alone", 9), ("roads", 256)])
def test_lines_do_not_depend_on_tiles(spark, name, tile):
    mask = masks()[name]
    n, m = mask.shape
    grid = {"xmin": 100.0, "ymax": 2.0 * n, "res": 2.0, "nrow": n, "ncol": m}
    got = skeleton.skeleton_lines(frame(spark, mask), grid, tile=tile).collect()
    cells = sorted([(round((2.0 * n - q.y) / 2 - 0.5), round((q.x - 100) / 2 - 0.5)) for q in r.geom] for r in got)
    assert cells == plain(mask, 5)
    assert len({r.id for r in got}) == len(got)


def test_thinning_by_exchange_is_that_of_the_whole_mask(spark):
    mask = np.zeros((60, 60), bool)
    mask[5:40, 5:50] = True  # takes more rounds than one exchange makes
    mask[20:24, 30:33] = False
    got = skeleton.thinned(frame(spark, mask), tile=13, rounds=2).collect()
    assert sorted((r.row, r.col) for r in got) == sorted(map(tuple, np.argwhere(stencils.thin(mask)).tolist()))


def test_no_cells_and_short_lines(spark):
    grid = {"xmin": 0.0, "ymax": 9.0, "res": 1.0, "nrow": 9, "ncol": 9}
    assert skeleton.skeleton_lines(frame(spark, np.zeros((3, 3), bool)).filter("row is not null"), grid).count() == 0
    line = np.zeros((9, 9), bool)
    line[4, 1:8] = True
    line[0, 0] = True  # a cell by itself is no line
    assert skeleton.skeleton_lines(frame(spark, line), grid).count() == 1
    assert skeleton.skeleton_lines(frame(spark, line), grid, length_min=6.5).count() == 0


def test_border_runs_go_on_over_stretches(spark, monkeypatch):
    strong = [(2, c) for c in (*range(3, 12), *range(14, 21), 25)] + [(r, 2) for r in range(5, 18)]
    df = spark.createDataFrame([(r, c, 1.0) for r, c in strong], "row int, col int, p double")
    grid = {"xmin": 0.0, "ymax": 30.0, "res": 1.0, "nrow": 30, "ncol": 30}
    whole = sorted(map(tuple, skeleton.border_runs(df, grid, 0.5).collect()))
    monkeypatch.setattr(skeleton, "STRETCH", 4)
    assert sorted(map(tuple, skeleton.border_runs(df, grid, 0.5).collect())) == whole and len(whole) >= 4
