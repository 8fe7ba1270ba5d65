import math

from timberline.operators import stations as st

INF = float("inf")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_truck_reasons_and_missing_columns(spark):
    rows = [(1, 1, 4.0, 0.02, INF, 6.0), (1, 2, 2.5, 0.02, INF, 6.0), (1, 3, 4.0, 0.2, INF, 6.0), (1, 4, 4.0, 0.02, 8.0, 6.0), (1, 5, 4.0, 0.02, None, 3.0)]
    df = frame(spark, rows, "trace_id long, station int, LARGEUR_ROULABLE double, PENTE_LONG double, RAYON_COURBURE double, GABARIT_LIBRE double")
    got = {r.station: (r.APTE_GRUMIER, r.MOTIF_INAPTITUDE) for r in st.trafficability(df).collect()}
    assert got == {1: (True, ""), 2: (False, "largeur"), 3: (False, "pente"), 4: (False, "rayon"), 5: (False, "gabarit")}
    assert {r.station: r.APTE_GRUMIER for r in st.trafficability(df.drop("GABARIT_LIBRE")).collect()}[5]
    summary = st.trafficability_summary(st.trafficability(df)).first()
    assert summary.part_apte == 0.2 and summary.n_gabarit == 1


def test_overhang(spark):
    df = frame(spark, [(1, 1, 4.0, 0.0, INF, 0.0, INF), (1, 2, 4.0, 0.0, INF, 1.5, 25.0), (1, 3, 4.0, 0.0, INF, 1.5, 3.0)],
               "trace_id long, station int, LARGEUR_ROULABLE double, PENTE_LONG double, RAYON_COURBURE double, SURPLOMB double, HAUT_SURPLOMB double")
    assert [r.MOTIF_INAPTITUDE for r in st.trafficability(df).orderBy("station").collect()] == ["", "", "surplomb"]


def test_passing_place(spark):
    widths = [3.0] * 8 + [7.0] * 5 + [3.0] * 8
    rows = [(1, k + 1, 2.0 * k, float(k), 0.0, w) for k, w in enumerate(widths)]
    schema = "trace_id long, station int, chainage double, x double, y double, LARGEUR_ROULABLE double"
    got = st.passing_places(frame(spark, rows, schema)).collect()
    assert len(got) == 1 and got[0].largeur_max == 7.0 and got[0].chainage == 16.0 and got[0].longueur == 8.0
    flat = [(1, k + 1, 2.0 * k, float(k), 0.0, 3.0) for k in range(20)]
    assert st.passing_places(frame(spark, flat, schema)).count() == 0


def test_state_runs_and_shares(spark):
    rows = [(1, k + 1, 2.0 * k, 0.9, 0.9 if k < 15 else 0.1) for k in range(30)]
    runs = st.state_runs(st.state_profile(frame(spark, rows, "trace_id long, station int, chainage double, sigma_geo double, sigma_surf double")))
    assert [r.etat_label for r in runs.orderBy("debut").collect()] == ["en_service", "abandonnee"]
    assert math.isclose(sum(r.pourcentage for r in st.state_summary(runs).collect()), 100, abs_tol=0.2)


def test_circle_of_sixty_metres(spark):
    rows = [(1, k, 2.0 * k, 1e6 + 60 * math.cos(k / 30), 7e6 + 60 * math.sin(k / 30)) for k in range(40)]
    got = st.fitted_radius(frame(spark, rows, "trace_id long, station int, chainage double, x double, y double"))
    assert all(abs(r.RAYON_COURBURE - 60) < 0.01 for r in got.collect())
    line = [(1, k, 2.0 * k, float(k), 2.0 * k) for k in range(12)]
    got = st.fitted_radius(frame(spark, line, "trace_id long, station int, chainage double, x double, y double"))
    assert all(r.RAYON_COURBURE > 1e5 for r in got.collect())


def test_otsu_splits_two_modes(spark):
    df = frame(spark, [(0.05 + k % 5 / 100,) for k in range(200)] + [(0.75 + k % 5 / 100,) for k in range(100)], "v double")
    assert 0.05 < st.otsu(df).first().seuil < 0.75


def test_applicable_lengths_sum_to_the_trace(spark):
    df = frame(spark, [(1, k, float(c)) for k, c in enumerate([0, 2, 4, 9, 10])], "trace_id long, station int, chainage double")
    assert df.select(st.applicable_length().alias("v")).groupBy().sum("v").first()[0] == 10.0


def test_empty_stations(spark):
    schema = "trace_id long, station int, chainage double, x double, y double, LARGEUR_ROULABLE double, PENTE_LONG double, RAYON_COURBURE double"
    df = frame(spark, [], schema)
    assert st.trafficability(df).count() == 0 and st.passing_places(df).count() == 0 and st.fitted_radius(df).count() == 0
