"""Queries over sources, sinks and the search kernel, with DuckDB's text written from their definitions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from timberline.functions import geometry as geo
from timberline.operators import ground, network, pathfind
from timberline.plans.views import load
from timberline.queries import query, r, rounded
from timberline.session import materialize, scratch_dir
from timberline.sources import acquisition, las, points, sinks, tiff


@query("""WITH h AS (SELECT id, atan2(y2 - y1, x2 - x1) AS a, atan2(x1 - 2500, y1 - 2400) AS b FROM v_segments), d AS (SELECT id, abs(a - b) AS d FROM h)
SELECT id, round(least(d % pi(), pi() - d % pi()), 6) AS sans_sens, round(least(d, 2 * pi() - d), 6) AS avec_sens FROM d""", "v_segments")
def angle_gaps(spark, sf):
    s = load(spark, sf, "v_segments")[0].select("id", F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("a"), F.atan2(F.col("x1") - 2500, F.col("y1") - 2400).alias("b"))
    return s.select("id", r(geo.undirected_gap("a", "b"), 6).alias("sans_sens"), r(geo.directed_gap("a", "b"), 6).alias("avec_sens"))


@query("SELECT id, x1, y1, x2, y2, cl_admin FROM v_segments", "v_segments")
def stored_layers(spark, sf):
    """A layer that was written over an older one and read again."""
    folder = f"{scratch_dir(spark)}/layers-{uuid.uuid4().hex}"
    seg = load(spark, sf, "v_segments")[0].select("id", "x1", "y1", "x2", "y2", "cl_admin")
    sinks.write_layers({"troncons": seg.limit(1)}, folder)
    return spark.read.parquet(sinks.write_layers({"troncons": seg}, folder)[0])


@query("SELECT x, y, h, cls FROM v_points WHERE x BETWEEN 10 AND 40.5 AND y BETWEEN 5 AND 30 AND row % 4 IN (1, 2)", "v_points")
def points_in_box(spark, sf):
    stored = materialize(load(spark, sf, "v_points")[0].withColumn("tile_key", F.concat(F.lit("t"), F.col("row") % 4)))
    return points.read_points(spark, [stored._timberline_path], (10.0, 5.0, 40.5, 30.0), ["t1", "t2"]).select("x", "y", "h", "cls")


@query("SELECT x, y, h, cls FROM v_points WHERE x BETWEEN 10 AND 40.5 AND y BETWEEN 20 AND 60", "v_points")
def points_by_curve(spark, sf):
    """All points laid out along a curve, and those of a rectangle read from there."""
    path = f"{scratch_dir(spark)}/curve-{uuid.uuid4().hex}"
    points.write_by_curve(load(spark, sf, "v_points")[0].select("x", "y", "h", "cls"), path)
    return points.read_points(spark, [path], (10.0, 20.0, 40.5, 60.0))


@query("""SELECT x, y, h AS z, cls, round(h - (0.5E0 * x - 0.25E0 * y), 6) AS hauteur FROM v_points WHERE x BETWEEN 8 AND 56 AND y BETWEEN 56.5 AND 61""", "v_points")
def heights_above_ground(spark, sf):
    """Points over a triangulated ground that is a plane, so that any triangulation of the table's ground points must give it."""
    p = load(spark, sf, "v_points")[0].select("x", "y", F.col("h").alias("z"), "cls")
    base = p.filter("cls = 2").select("x", "y", (F.lit(0.5) * F.col("x") - F.lit(0.25) * F.col("y")).alias("z"))
    got = ground.normalised(p.filter("x between 8 and 56 and y between 56.5 and 61"), base, tile=16.0, halo=8.0)
    return got.select("x", "y", "z", "cls", r("h", 6).alias("hauteur"))


@query("SELECT round(x, 3) AS x, round(y, 3) AS y, round(h, 3) AS z, CAST(cls AS INT) AS classification FROM v_points WHERE x BETWEEN 10 AND 40.5 AND y BETWEEN 20 AND 60", "v_points")
def las_points(spark, sf):
    """All points as LAS files, and those of a rectangle read from them by ranges."""
    cloud = load(spark, sf, "v_points")[0].select("x", "y", F.col("h").alias("z"), F.col("cls").alias("classification"))
    files = las.write_points(cloud, f"{scratch_dir(spark)}/las-{uuid.uuid4().hex}")
    return rounded(las.points(spark, files, (10.0, 20.0, 40.5, 60.0)).select("x", "y", "z", "classification"), 3, "x", "y", "z")


@query("SELECT count(*) AS n_points, min(x) AS xmin, max(y) AS ymax, round(max(h), 3) AS zmax FROM v_points", "v_points")
def las_headers(spark, sf):
    """What the first bytes of the files say of all points."""
    cloud = load(spark, sf, "v_points")[0].select("x", "y", F.col("h").alias("z"), F.col("cls").alias("classification"))
    files = las.write_points(cloud, f"{scratch_dir(spark)}/las-{uuid.uuid4().hex}")
    return las.headers(spark, files).agg(F.sum("n_points").alias("n_points"), F.min("xmin").alias("xmin"), F.max("ymax").alias("ymax"), r(F.max("zmax"), 3).alias("zmax"))


@query("SELECT col + 0.5 AS x, -row - 0.5 AS y, z AS value FROM v_ground WHERE col BETWEEN 10 AND 49", "v_ground")
def tiff_cells(spark, sf):
    """All heights as GeoTIFF tiles, and those of a rectangle read from them chunk by chunk."""
    cells = load(spark, sf, "v_ground")[0]
    grid = {"xmin": 0.0, "ymax": 0.0, "res": 1.0, "nrow": cells.agg(F.max("row")).first()[0] + 1, "ncol": 64}
    files = tiff.write_rasters(cells, grid, f"{scratch_dir(spark)}/tiff-{uuid.uuid4().hex}", "z", tile=256, chunk=16)
    return tiff.cells(spark, files, (10.0, -1e12, 50.0, 0.0)).filter("value is not null").select("x", "y", "value")


@query("""WITH s AS (SELECT x1, y1, x2, y2 FROM v_traces UNION ALL SELECT x2, y2, x3, y3 FROM v_traces), p AS (SELECT DISTINCT x, y FROM v_points),
t AS (SELECT x, y, x1, y1, x2, y2, greatest(0, least(1, ((x-x1)*(x2-x1)+(y-y1)*(y2-y1)) / nullif((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1), 0))) AS t FROM p, s),
c AS (SELECT DISTINCT x, y FROM t WHERE sqrt((x-x1-coalesce(t, 0)*(x2-x1))*(x-x1-coalesce(t, 0)*(x2-x1)) + (y-y1-coalesce(t, 0)*(y2-y1))*(y-y1-coalesce(t, 0)*(y2-y1))) <= 0.3)
SELECT x, y, count(*) AS n, max(h) AS h FROM v_points JOIN c USING (x, y) GROUP BY x, y""", "v_traces", "v_points")
def points_in_corridor(spark, sf):
    t, p = load(spark, sf, "v_traces", "v_points")
    legs = t.select("x1", "y1", "x2", "y2").union(t.select("x2", "y2", "x3", "y3"))
    return points.in_corridor(p, legs, 0.3).groupBy("x", "y").agg(F.count("*").alias("n"), F.max("h").alias("h"))


@query("""WITH e AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM v_stations), k AS (SELECT *, CAST(ceil((x1 - x0) / 7) AS INT) AS nx, CAST(ceil((y1 - y0) / 7) AS INT) AS ny FROM e),
i AS (SELECT *, unnest(range(nx)) AS i FROM k), j AS (SELECT *, unnest(range(ny)) AS j FROM i)
SELECT round(x0 + i * 7, 6) AS xmin, round(y0 + j * 7, 6) AS ymin, round(least(x0 + (i + 1) * 7, x1), 6) AS xmax, round(least(y0 + (j + 1) * 7, y1), 6) AS ymax FROM j""", "v_stations")
def image_requests(spark, sf):
    e = acquisition.extent(load(spark, sf, "v_stations")[0]).first()
    return rounded(acquisition.image_tiles(spark, (e["xmin"], e["ymin"], e["xmax"], e["ymax"]), 7.0), 6, "xmin", "ymin", "xmax", "ymax")


@query("""WITH q AS (SELECT x1, y1, floor(x1 / 1250) AS i, floor(y1 / 1250) AS j FROM v_segments)
SELECT CAST(i * 1250 AS DOUBLE) AS xmin, CAST(j * 1250 AS DOUBLE) AS ymin, count(*) AS n FROM q WHERE x1 < 5000 AND y1 < 5000 GROUP BY i, j""", "v_segments")
def harvested_areas(spark, sf):
    """Quarters of an area that a server answers only up to 1,300 metres, with what is in them."""
    seg = materialize(load(spark, sf, "v_segments")[0].select("x1", "y1"))

    def fetch(box):
        if box[2] - box[0] > 1300:
            return acquisition.Answer("volume")
        n = seg.filter(f"x1 >= {box[0]} and x1 < {box[2]} and y1 >= {box[1]} and y1 < {box[3]}").count()
        return acquisition.Answer("ok", [(float(box[0]), float(box[1]), n)] if n else [])

    rows = acquisition.harvest(lambda b: acquisition.ask(lambda server, box: fetch(box), ["a"], b), (0.0, 0.0, 5000.0, 5000.0))
    return spark.createDataFrame(rows, "xmin double, ymin double, n long")


@query("""WITH RECURSIVE e AS (SELECT x1 || ' ' || y1 AS a, x2 || ' ' || y2 AS b, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS len FROM v_segments),
n AS (SELECT x1 || ' ' || y1 AS node, x1 AS x, y1 AS y FROM v_segments UNION SELECT x2 || ' ' || y2, x2, y2 FROM v_segments),
l AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
c(node, comp) USING KEY (node) AS (SELECT node, node AS comp FROM n UNION ALL
  (SELECT q.node, q.comp FROM (SELECT l.v AS node, min(c.comp) AS comp FROM c JOIN l ON l.u = c.node GROUP BY l.v) q JOIN recurring.c o ON o.node = q.node WHERE q.comp < o.comp)),
p AS (SELECT *, floor((x1 + x2) / 200) + i AS gx, floor((y1 + y2) / 200) + j AS gy FROM v_segments, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j) WHERE cl_admin = 'Nationale'),
d AS (SELECT node, x, y, x1, y1, x2, y2, greatest(0, least(1, ((x-x1)*(x2-x1)+(y-y1)*(y2-y1)) / ((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) AS t FROM n JOIN p ON gx = floor(x / 100) AND gy = floor(y / 100)),
r AS (SELECT DISTINCT comp FROM d JOIN c USING (node) WHERE sqrt((x-x1-t*(x2-x1))*(x-x1-t*(x2-x1)) + (y-y1-t*(y2-y1))*(y-y1-t*(y2-y1))) <= 5),
k AS (SELECT e.len, c.comp, r.comp IS NULL AS lost FROM e JOIN c ON c.node = e.a LEFT JOIN r ON r.comp = c.comp)
SELECT count(*) AS n_aretes, count(DISTINCT comp) AS n_composants, round(coalesce(sum(CASE WHEN lost THEN len END), 0), 3) AS longueur_deconnectee, (SELECT count(*) FROM n) AS n_noeuds FROM k""", "v_segments")
def network_parts(spark, sf):
    """Edges, nodes, components and what of them no national road reaches."""
    seg = load(spark, sf, "v_segments")[0].select("id", "x1", "y1", "x2", "y2", "cl_admin")
    edges, nodes = network.network(seg.drop("cl_admin"), seg.filter("cl_admin = 'Nationale'").select("x1", "y1", "x2", "y2"), 5.0)
    return rounded(network.network_summary(edges, nodes), 3, "longueur_deconnectee")


#: Rows and columns of the moves of a king and a knight, and the cell beside a knight's move that must be open.
_MOVES = ", ".join(f"({dr}, {dc}, {dr - (dr > 0) + (dr < 0) if knight else 0}, {dc - (dc > 0) + (dc < 0) if knight else 0})"
                   for dr in range(-2, 3) for dc in range(-2, 3) for knight in [abs(dr) + abs(dc) == 3] if knight or 0 < max(abs(dr), abs(dc)) == 1)


@query(f"""WITH RECURSIVE c AS (SELECT row, col, 1 / greatest(sigma, 0.05E0) AS w FROM v_ground WHERE sigma >= 0.08),
m AS (SELECT * FROM (VALUES {_MOVES}) m(dr, dc, sr, sc)),
e AS (SELECT a.row, a.col, b.row AS r2, b.col AS c2, (a.w + b.w) / 2 * (sqrt(dr * dr + dc * dc) * 2) AS price FROM c a, m JOIN c b ON b.row = a.row + m.dr AND b.col = a.col + m.dc
  WHERE (sr = 0 AND sc = 0) OR EXISTS (SELECT 1 FROM c s WHERE s.row = a.row + m.sr AND s.col = a.col + m.sc)),
f(row, col, cost) USING KEY (row, col) AS (
  SELECT row, col, CAST(0 AS DOUBLE) AS cost FROM c WHERE row % 48 = 11 AND col % 40 = 9
  UNION ALL
  (SELECT n.row, n.col, n.cost FROM (SELECT e.r2 AS row, e.c2 AS col, min(f.cost + e.price) AS cost FROM f JOIN e ON e.row = f.row AND e.col = f.col GROUP BY ALL) n
    LEFT JOIN recurring.f o ON o.row = n.row AND o.col = n.col WHERE o.cost IS NULL OR n.cost < o.cost))
SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, round(cost, 6) AS cout FROM f""", "v_ground")
def cost_field(spark, sf):
    """Least cost over given cells from the nearest of many starts, in tiles that hand labels over their borders."""
    g = load(spark, sf, "v_ground")[0].filter("sigma >= 0.08")
    starts = g.filter("row % 48 = 11 and col % 40 = 9")
    got = pathfind.cost_field(g.select("row", "col", "sigma"), starts, headings=1, turning=0.0, res=2.0, tile=64)
    return got.select("row", "col", r("cost", 6).alias("cout"))
