"""Queries over profiles, traces and tiles, with DuckDB's text written from their definitions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators import earthworks, measure, stencils
from timberline.plans.views import load
from timberline.queries import GRID, _traces as traces, query, r, rounded, rounded_double
from timberline.session import scratch_dir
from timberline.sources import cache


def stations_sql(step: float) -> str:
    """CTEs up to ``st(trace_id, station, chainage, x, y, nx, ny)``: stations of ``v_traces`` every ``step``."""
    return f"""lg AS (SELECT trace_id, 0 AS leg, x1 AS ax, y1 AS ay, x2 AS bx, y2 AS b_y FROM v_traces UNION ALL SELECT trace_id, 1, x2, y2, x3, y3 FROM v_traces),
ln AS (SELECT *, sqrt((bx-ax)*(bx-ax)+(b_y-ay)*(b_y-ay)) AS len FROM lg),
en AS (SELECT *, sum(len) OVER (PARTITION BY trace_id ORDER BY leg) AS e, sum(len) OVER (PARTITION BY trace_id) AS total FROM ln WHERE len > 0),
lb AS (SELECT *, e - len AS b FROM en WHERE total >= {2 * step}),
mk AS (SELECT *, k * {step}E0 AS chainage FROM (SELECT *, unnest(range(CAST(ceil(b / {step} - 1e-9) AS BIGINT), CAST(ceil(e / {step} - 1e-9) AS BIGINT))) AS k FROM lb) WHERE k * {step}E0 < total - 1e-9
  UNION ALL SELECT *, 0 AS k, total AS chainage FROM lb WHERE e >= total - 1e-9),
xy AS (SELECT trace_id, chainage, ax + (chainage - b) / len * (bx - ax) AS x, ay + (chainage - b) / len * (b_y - ay) AS y FROM mk),
dr AS (SELECT *, row_number() OVER o AS station, coalesce(lead(x) OVER o, x) - coalesce(lag(x) OVER o, x) AS tx, coalesce(lead(y) OVER o, y) - coalesce(lag(y) OVER o, y) AS ty FROM xy WINDOW o AS (PARTITION BY trace_id ORDER BY chainage)),
st AS (SELECT trace_id, station, chainage, x, y, CASE WHEN tx*tx+ty*ty > 0 THEN -ty / sqrt(tx*tx+ty*ty) ELSE 0 END AS nx, CASE WHEN tx*tx+ty*ty > 0 THEN tx / sqrt(tx*tx+ty*ty) ELSE 1 END AS ny FROM dr)"""


def profiles_sql(step: float, half: float, across: float, value: str) -> str:
    """CTEs up to ``pr(trace_id, station, chainage, k, z)``: bilinear samples of ``value`` over ``v_cells`` across each station."""
    n = round(half / across)
    return f"""{stations_sql(step)},
pt AS (SELECT trace_id, station, chainage, k, x - nx * k * {across} - 0.5 AS fx, 64 - (y - ny * k * {across}) - 0.5 AS fy FROM (SELECT *, unnest(range(-{n}, {n + 1})) AS k FROM st)),
pf AS (SELECT *, CAST(floor(fx) AS INT) AS c0, CAST(floor(fy) AS INT) AS r0, fx - floor(fx) AS tx, fy - floor(fy) AS ty FROM pt),
co AS (SELECT trace_id, station, chainage, k, r0 AS rr, c0 AS cc, (1-tx)*(1-ty) AS w FROM pf UNION ALL SELECT trace_id, station, chainage, k, r0, c0+1, tx*(1-ty) FROM pf
  UNION ALL SELECT trace_id, station, chainage, k, r0+1, c0, (1-tx)*ty FROM pf UNION ALL SELECT trace_id, station, chainage, k, r0+1, c0+1, tx*ty FROM pf),
pr AS (SELECT co.trace_id, co.station, co.chainage, co.k, CASE WHEN count(v) = count(*) THEN sum(w * v) END AS z FROM co LEFT JOIN (SELECT row, col, {value} AS v FROM v_cells) c ON c.row = rr AND c.col = cc WHERE w > 0 GROUP BY ALL)"""


def open_run_sql(source: str, limit: float, n: int, across: float) -> str:
    """CTEs up to ``opn(trace_id, station, g, d, cut)``: reach of values up to ``limit`` around the middle of ``source(trace_id, station, k, v)``."""
    return f"""sd AS (SELECT trace_id, station, s, abs(k) AS j, v FROM {source}, (SELECT unnest([-1, 1]) AS s) WHERE k = 0 OR sign(k) = s),
fb AS (SELECT trace_id, station, s, min(j) FILTER (WHERE v IS NULL OR v > {limit}) AS bad FROM sd GROUP BY ALL),
re AS (SELECT fb.trace_id, fb.station, fb.s, bad, CASE WHEN bad = 0 THEN 0 WHEN bad IS NULL THEN {n * across}
    WHEN b.v IS NOT NULL AND b.v > a.v THEN (bad - 1 + least(1, greatest(0, ({limit} - a.v) / (b.v - a.v)))) * {across} ELSE (bad - 1) * {across} END AS reach
  FROM fb LEFT JOIN sd a ON a.trace_id = fb.trace_id AND a.station = fb.station AND a.s = fb.s AND a.j = bad - 1 LEFT JOIN sd b ON b.trace_id = fb.trace_id AND b.station = fb.station AND b.s = fb.s AND b.j = bad),
opn AS (SELECT trace_id, station, sum(reach) FILTER (WHERE s = -1) AS g, sum(reach) FILTER (WHERE s = 1) AS d, bool_or(bad IS NULL) AS cut FROM re GROUP BY ALL)"""


_HEIGHT = "CASE WHEN rugosite > 0.5 THEN 0.0E0 ELSE 10.0E0 END"


def heights(spark, sf) -> DataFrame:
    return load(spark, sf, "v_cells")[0].withColumn("h", F.when(F.col("rugosite") > 0.5, 0.0).otherwise(10.0))


@query(f"WITH {profiles_sql(4, 3, 0.5, 'z')} SELECT trace_id, CAST(station AS INT) AS station, CAST(k AS INT) AS k, round(z, 5) AS z FROM pr", "v_traces", "v_cells")
def cross_profiles(spark, sf):
    got = measure.cross_profiles(measure.densify(traces(spark, sf), 4.0), load(spark, sf, "v_cells")[0], GRID, half=3.0)
    return got.select("trace_id", "station", F.posexplode("z").alias("k", "z")).select("trace_id", "station", (F.col("k") - 6).alias("k"), r("z", 5).alias("z"))


@query(f"""WITH {profiles_sql(4, 5, 0.5, 'z')}, a AS (SELECT trace_id, station, max(z) FILTER (WHERE k = -8) AS za, max(z) FILTER (WHERE k = -4) AS zb, max(z) FILTER (WHERE k = 4) AS zc, max(z) FILTER (WHERE k = 8) AS zd FROM pr GROUP BY ALL),
i AS (SELECT trace_id, abs(zc - zb) / 4 AS i, (abs(za - zb) + abs(zd - zc)) / 2 / 2 AS o FROM a)
SELECT trace_id, round(avg(CASE WHEN o >= 0.1 THEN CASE WHEN i < 0.5 * o THEN 1.0E0 ELSE 0 END END), 6) AS part_plateforme FROM i GROUP BY trace_id""", "v_traces", "v_cells")
def platform_share(spark, sf):
    p = measure.cross_profiles(measure.densify(traces(spark, sf), 4.0), load(spark, sf, "v_cells")[0], GRID, half=5.0)
    return rounded(earthworks.platform_share(p, 4.0, 5.0, 0.5), 6, "part_plateforme")


@query(f"""WITH {profiles_sql(2, 4, 0.5, _HEIGHT)}, v AS (SELECT trace_id, station, k, z AS v FROM pr), {open_run_sql('v', 2.0, 8, 0.5)},
o AS (SELECT trace_id, station, min(v) FILTER (WHERE abs(k) <= 4 AND v > 2) AS low FROM v GROUP BY ALL)
SELECT opn.trace_id, CAST(opn.station AS INT) AS station, round(g + d, 4) AS LARGEUR_DEGAGEE, round(g, 4) AS DEGAGE_G, round(d, 4) AS DEGAGE_D, cut AS TRONQUE, round(greatest(0, 4 - g - d), 4) AS SURPLOMB,
  round(coalesce(low, CAST('Infinity' AS DOUBLE)), 4) AS HAUT_SURPLOMB FROM opn JOIN o USING (trace_id, station)""", "v_traces", "v_cells")
def lateral_clearance(spark, sf):
    p = measure.cross_profiles(measure.densify(traces(spark, sf), 2.0), heights(spark, sf), GRID, "h", half=4.0)
    got = measure.lateral_clearance(p, p.select("trace_id", "station", F.lit(4.0).alias("LARGEUR_ROULABLE")), half=4.0)
    return got.withColumns({c: rounded_double(c, 4) for c in ("LARGEUR_DEGAGEE", "DEGAGE_G", "DEGAGE_D", "SURPLOMB", "HAUT_SURPLOMB")})


@query(f"""WITH {profiles_sql(2, 4, 0.5, 'vesselness')}, v AS (SELECT trace_id, station, k, avg(z) OVER (PARTITION BY trace_id, station ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM pr), {open_run_sql('v', 0.5, 8, 0.5)},
m AS (SELECT trace_id, station, v FROM v WHERE k = 0)
SELECT trace_id, CAST(station AS INT) AS station, round(CASE WHEN NOT cut THEN g + d END, 4) AS LARGEUR_NDVI, cut AS TRONQUE, round(v, 5) AS NDVI_AXE FROM opn JOIN m USING (trace_id, station)""", "v_traces", "v_cells")
def mineral_width(spark, sf):
    p = measure.cross_profiles(measure.densify(traces(spark, sf), 2.0), load(spark, sf, "v_cells")[0], GRID, "vesselness", half=4.0)
    return rounded(rounded(measure.mineral_width(p, 0.5, half=4.0, step=0.5), 4, "LARGEUR_NDVI"), 5, "NDVI_AXE")


def _profile_rows(spark, sf) -> DataFrame:
    """Whole profiles of 17 samples, heights a tenth of the view's."""
    p = load(spark, sf, "v_profiles")[0].withColumn("z", F.col("z") / 10)
    rows = p.groupBy("trace_id", "station").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "z"))), lambda s: s["z"]).alias("z"))
    return rows.filter(F.size("z") == 17).withColumn("chainage", F.col("station") * 2.0).withColumn("x", F.col("chainage")).withColumn("y", F.lit(0.0))


_SMOOTHED = """w AS (SELECT trace_id, station FROM v_profiles GROUP BY ALL HAVING count(*) = 17),
pr AS (SELECT trace_id, station, k - 8 AS k, avg(z / 10) OVER (PARTITION BY trace_id, station ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS z FROM v_profiles JOIN w USING (trace_id, station))"""


@query(f"""WITH {_SMOOTHED},
pl AS (SELECT trace_id, station, regr_slope(z, k * 0.5E0) AS c, regr_intercept(z, k * 0.5E0) AS l, count(z) AS n FROM pr WHERE abs(k) <= 2 GROUP BY ALL),
gp AS (SELECT pr.trace_id, pr.station, k, z, n, c, abs(z - (l + c * k * 0.5)) AS gap FROM pr JOIN pl USING (trace_id, station)),
sd AS (SELECT *, abs(k) AS j, coalesce(gap <= 0.1, FALSE) AS ok FROM gp, (SELECT unnest([-1, 1]) AS s) WHERE sign(k) = s),
br AS (SELECT *, NOT ok AND NOT coalesce(lag(ok) OVER o, TRUE) AND NOT coalesce(lag(ok, 2) OVER o, TRUE) AS br FROM sd WINDOW o AS (PARTITION BY trace_id, station, s ORDER BY j)),
fb AS (SELECT trace_id, station, s, coalesce(min(j) FILTER (WHERE br), 99) AS b FROM br GROUP BY ALL),
la AS (SELECT br.trace_id, br.station, br.s, coalesce(max(j) FILTER (WHERE ok AND j < b), 0) AS last FROM br JOIN fb USING (trace_id, station, s) GROUP BY ALL),
ed AS (SELECT la.trace_id, la.station, la.s, last, i.gap AS gi, x.gap AS gx FROM la LEFT JOIN gp i ON i.trace_id = la.trace_id AND i.station = la.station AND i.k = la.s * last LEFT JOIN gp x ON x.trace_id = la.trace_id AND x.station = la.station AND x.k = la.s * (last + 1)),
be AS (SELECT trace_id, station, s, last, (last + CASE WHEN gx > greatest(0.1, coalesce(gi, 0.1)) THEN (0.1 - coalesce(gi, 0)) / (gx - coalesce(gi, 0)) ELSE 0 END) * 0.5 AS reach FROM ed),
sh AS (SELECT trace_id, station, sum(reach) FILTER (WHERE s = -1) AS g, sum(reach) FILTER (WHERE s = 1) AS d FROM be GROUP BY ALL),
oc AS (SELECT be.trace_id, be.station, be.s, e.z AS ze, p.k * be.s AS j, p.z, max(p.z) OVER (PARTITION BY be.trace_id, be.station, be.s ORDER BY p.k * be.s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later
  FROM be JOIN pr e ON e.trace_id = be.trace_id AND e.station = be.station AND e.k = be.s * be.last JOIN pr p ON p.trace_id = be.trace_id AND p.station = be.station AND p.k * be.s BETWEEN be.last + 1 AND be.last + 8 AND p.z IS NOT NULL),
di AS (SELECT trace_id, station, count(DISTINCT s) AS n FROM oc WHERE ze - z >= 0.2 AND later - z >= 0.2 GROUP BY ALL)
SELECT trace_id, CAST(station AS INT) AS station, round(CASE WHEN pl.n >= 3 THEN greatest(0, g + d) ELSE 0 END, 4) AS LARGEUR_ROULABLE, round(CASE WHEN pl.n >= 3 AND g + d > 0 THEN g END, 4) AS BORD_G, round(CASE WHEN pl.n >= 3 AND g + d > 0 THEN d END, 4) AS BORD_D,
  round(CASE WHEN pl.n >= 3 THEN c END, 5) + 0.0E0 AS DEVERS, CAST(CASE WHEN pl.n >= 3 AND g + d > 0 THEN coalesce(di.n, 0) ELSE 0 END AS INT) AS FOSSES FROM pl JOIN sh USING (trace_id, station) LEFT JOIN di USING (trace_id, station)""", "v_profiles")
def flat_widths(spark, sf):
    got = measure.measure(_profile_rows(spark, sf), 4.0, method="planeite")
    return rounded(rounded(got.select("trace_id", "station", "LARGEUR_ROULABLE", "BORD_G", "BORD_D", "DEVERS", "FOSSES"), 4, "LARGEUR_ROULABLE", "BORD_G", "BORD_D"), 5, "DEVERS").withColumn("DEVERS", F.col("DEVERS") + 0.0)


@query(f"""WITH {_SMOOTHED},
gr AS (SELECT trace_id, station, k, z, CASE k WHEN -8 THEN (lead(z) OVER o - z) / 0.5 WHEN 8 THEN (z - lag(z) OVER o) / 0.5 ELSE (lead(z) OVER o - lag(z) OVER o) / 1.0 END AS g FROM pr WINDOW o AS (PARTITION BY trace_id, station ORDER BY k)),
fl AS (SELECT *, coalesce(abs(g) <= 0.15, FALSE) AS f FROM gr),
rn AS (SELECT *, k - row_number() OVER (PARTITION BY trace_id, station ORDER BY k) AS run FROM fl WHERE f),
ra AS (SELECT trace_id, station, min(k) AS a, max(k) AS b, regr_slope(z, k * 0.5E0) AS c, count(z) AS n FROM rn GROUP BY trace_id, station, run),
be AS (SELECT *, row_number() OVER (PARTITION BY trace_id, station ORDER BY greatest(a, -b, 0), a) AS p FROM ra)
SELECT w.trace_id, CAST(w.station AS INT) AS station, round(coalesce((b - a) * 0.5, 0), 4) AS LARGEUR_ROULABLE, round(CASE WHEN n >= 2 THEN c END, 5) + 0.0E0 AS DEVERS FROM w LEFT JOIN be ON be.trace_id = w.trace_id AND be.station = w.station AND p = 1""", "v_profiles")
def gradient_widths(spark, sf):
    got = measure.measure(_profile_rows(spark, sf), 4.0, method="gradient")
    return rounded(rounded(got.select("trace_id", "station", "LARGEUR_ROULABLE", "DEVERS"), 4, "LARGEUR_ROULABLE"), 5, "DEVERS").withColumn("DEVERS", F.col("DEVERS") + 0.0)


@query("""WITH s AS (SELECT trace_id, station, 0.1013717E0 + abs(PENTE_LONG) AS s FROM v_stations),
b AS (SELECT trace_id, station, s, j, 0.6 * (j * 0.25) AS fall, s * (2 + j * 0.25) AS ground FROM s, (SELECT unnest(range(1, 21)) AS j)),
f AS (SELECT trace_id, station, min(j) FILTER (WHERE ground <= fall) AS stop FROM b GROUP BY ALL),
k AS (SELECT b.trace_id, b.station, sum(CASE WHEN ground > fall THEN (ground - fall) * 0.25 END) AS fill, sum(CASE WHEN fall > ground THEN (fall - ground) * 0.25 END) AS cut, max(stop) AS stop FROM b JOIN f USING (trace_id, station) WHERE j <= stop GROUP BY ALL)
SELECT trace_id, station, round(2 * coalesce(cut, 0), 5) AS section_deblai, round(2 * coalesce(fill, 0) + 4.5 * s, 5) AS section_remblai, (2 * (8 + stop) + 1) * 0.25 AS emprise FROM k JOIN s USING (trace_id, station)""", "v_stations")
def earthwork_ridges(spark, sf):
    """Platforms of four metres on ridges: all fill between the edge and where the bank meets the ground."""
    st = load(spark, sf, "v_stations")[0].select("trace_id", "station", "chainage", "x", "y", (0.1013717 + F.abs("PENTE_LONG")).alias("s"))
    z = F.transform(F.sequence(F.lit(-28), F.lit(28)), lambda k: -F.col("s") * F.abs(k * 0.25))
    got = earthworks.earthworks(st.withColumn("z", z), 4.0, 7.0, 0.25)
    return rounded(got.select("trace_id", "station", "section_deblai", "section_remblai", "emprise"), 5, "section_deblai", "section_remblai")


def _scale_sql(name: str, s: int) -> str:
    n = 3 * s
    weight = f"exp(-0.5 * i * i / {float(s * s)}E0)"
    return f"""{name}k AS (SELECT i, {weight} / sum({weight}) OVER () AS w FROM (SELECT unnest(range(-{n}, {n + 1})) AS i)),
{name}h AS (SELECT c.row, c.col, CASE WHEN count(n.z) = {2 * n + 1} THEN sum(w * n.z) END AS z FROM v_cells c, {name}k k LEFT JOIN v_cells n ON n.row = c.row AND n.col = c.col + i GROUP BY c.row, c.col),
{name}s AS (SELECT c.row, c.col, CASE WHEN count(n.z) = {2 * n + 1} THEN sum(w * n.z) END AS z FROM {name}h c, {name}k k LEFT JOIN {name}h n ON n.row = c.row + i AND n.col = c.col GROUP BY c.row, c.col),
{name}d AS (SELECT m.row, m.col, {s * s} * (e.z - 2 * m.z + w.z) AS hxx, {s * s} * (s.z - 2 * m.z + n.z) AS hyy, {s * s} * (ne.z - nw.z - se.z + sw.z) / 4 AS hxy FROM {name}s m
  LEFT JOIN {name}s e ON e.row = m.row AND e.col = m.col + 1 LEFT JOIN {name}s w ON w.row = m.row AND w.col = m.col - 1 LEFT JOIN {name}s s ON s.row = m.row + 1 AND s.col = m.col LEFT JOIN {name}s n ON n.row = m.row - 1 AND n.col = m.col
  LEFT JOIN {name}s ne ON ne.row = m.row - 1 AND ne.col = m.col + 1 LEFT JOIN {name}s nw ON nw.row = m.row - 1 AND nw.col = m.col - 1 LEFT JOIN {name}s se ON se.row = m.row + 1 AND se.col = m.col + 1 LEFT JOIN {name}s sw ON sw.row = m.row + 1 AND sw.col = m.col - 1),
{name}e AS (SELECT *, (hxx + hyy) / 2 AS m, sqrt((hxx - hyy) / 2 * ((hxx - hyy) / 2) + hxy * hxy) AS d FROM {name}d),
{name}l AS (SELECT *, CASE WHEN abs(m - d) > abs(m + d) THEN m + d ELSE m - d END AS l1, CASE WHEN abs(m - d) > abs(m + d) THEN m - d ELSE m + d END AS l2 FROM {name}e),
{name}c AS (SELECT 0.5 * max(sqrt(l1 * l1 + l2 * l2)) AS c FROM {name}l),
{name}v AS (SELECT row, col, CASE WHEN l2 > 0 THEN exp(-(l1 / l2) * (l1 / l2) / 0.5) * (1 - exp(-(l1 * l1 + l2 * l2) / (2 * c * c))) ELSE 0 END AS v,
  ((degrees(atan2(l1 - hxx, hxy)) % 180) + 180) % 180 AS t FROM {name}l, {name}c)"""


@query(f"WITH {_scale_sql('fine', 1)}, {_scale_sql('wide', 2)} SELECT row, col, round(greatest(a.v, b.v), 5) AS vesselness, round(CASE WHEN b.v > a.v THEN b.t ELSE a.t END, 4) AS theta FROM finev a JOIN widev b USING (row, col)", "v_cells")
def vessels(spark, sf):
    got = stencils.vesselness(load(spark, sf, "v_cells")[0].select("row", "col", "z"), GRID, (1, 2), tile=32)
    return rounded(rounded(got, 5, "vesselness"), 4, "theta")


_SKY = """sh AS (SELECT DISTINCT d, CAST(round(k / 3.0E0 * cos(2 * pi() * d / 8)) AS INT) AS dr, CAST(round(k / 3.0E0 * sin(2 * pi() * d / 8)) AS INT) AS dc FROM (SELECT unnest(range(8)) AS d), (SELECT unnest(range(1, 10)) AS k)),
sd AS (SELECT *, sqrt(dr * dr + dc * dc) AS dist FROM sh WHERE dr <> 0 OR dc <> 0),
rf AS (SELECT c.row, c.col, c.z, d, dist, abs(c.row + dr) AS a, abs(c.col + dc) AS b FROM v_cells c, sd),
p AS (SELECT *, CASE WHEN a > 63 THEN 126 - a ELSE a END AS nr, CASE WHEN b > 63 THEN 126 - b ELSE b END AS nc FROM rf),
m AS (SELECT p.row, p.col, d, atan(coalesce(max((n.z - p.z) / dist), -1000)) AS up, atan(coalesce(max((p.z - n.z) / dist), -1000)) AS down FROM p LEFT JOIN v_cells n ON n.row = nr AND n.col = nc GROUP BY p.row, p.col, d)"""


@query(f"WITH {_SKY} SELECT row, col, round(avg(1 - sin(greatest(up, 0))), 5) AS svf, round(degrees(pi() / 2 - avg(up)), 5) AS openness_pos, round(degrees(pi() / 2 - avg(down)), 5) AS openness_neg FROM m GROUP BY row, col", "v_cells")
def micro_relief(spark, sf):
    got = stencils.micro_relief(load(spark, sf, "v_cells")[0], GRID, 3, 8, tile=24)
    return rounded(got, 5, "svf", "openness_pos", "openness_neg")


@query("""WITH a AS (SELECT CAST(n_regionkey AS INT) AS k, CAST(count(*) AS INT) AS n FROM nation GROUP BY n_regionkey),
s AS (SELECT * FROM (VALUES (0, 'absent', 0), (1, 'agrees', 0), (2, 'ignored', 0), (3, 'fetched', 1), (4, 'agrees', 1)) AS t(step, why, k))
SELECT s.step, s.why, s.k, a.n FROM s JOIN a USING (k)""")
def cached_layers(spark, sf):
    """One layer asked for five times: without a copy, again, with other parameters that are ignored or heeded, again."""
    folder = f"{scratch_dir(spark)}/layers-{uuid.uuid4().hex}"
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    asked = [(0, "absent", 0, "reacquerir"), (1, "agrees", 0, "echouer"), (2, "ignored", 1, "ignorer"), (3, "fetched", 1, "reacquerir"), (4, "agrees", 1, "echouer")]
    out = None
    for step, why, k, policy in asked:
        got = cache.cached(spark, folder, "nations", "nation", {"region": k}, lambda k=k: nation.filter(F.col("n_regionkey") == k).select(F.col("n_regionkey").cast("int").alias("k")), policy)
        # the layer may be replaced by the next step, so its one-row summary is taken now
        row = got.groupBy("k").agg(F.count("*").cast("int").alias("n")).first()
        one = spark.range(1).select(F.lit(step).alias("step"), F.lit(why).alias("why"), F.lit(row["k"]).alias("k"), F.lit(row["n"]).alias("n"))
        out = one if out is None else out.union(one)
    return out
