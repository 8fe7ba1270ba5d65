"""Operators over stations: ordered points along a trace (``trace_id, station, chainage, x, y, ...``)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.geometry import circumradius, distance
from timberline.operators.cells import state, state_label


@dataclass(frozen=True)
class TruckLimits:
    """Least width, most slope either way, least radius, least clearance."""

    width: float = 3.0
    slope: float = 0.10
    radius: float = 12.0
    clearance: float = 4.5


def along(trace: str = "trace_id", order: str = "station"):
    return Window.partitionBy(trace).orderBy(order)


def trafficability(stations: DataFrame, limits: TruckLimits = TruckLimits()) -> DataFrame:
    """Append ``APTE_GRUMIER`` and ``MOTIF_INAPTITUDE``.

    Criteria in order: width, slope, radius, clearance, and overhang (an
    overhang whose height is below the clearance). A criterion takes part if
    its columns exist; a null value never blocks.
    """
    has = set(stations.columns)
    tests = [
        ("largeur", F.col("LARGEUR_ROULABLE") < limits.width),
        ("pente", F.abs("PENTE_LONG") > limits.slope),
        ("rayon", F.col("RAYON_COURBURE") < limits.radius),
    ]
    if "GABARIT_LIBRE" in has:
        tests.append(("gabarit", F.col("GABARIT_LIBRE") < limits.clearance))
    if {"SURPLOMB", "HAUT_SURPLOMB"} <= has:
        tests.append(("surplomb", (F.col("SURPLOMB") > 0) & (F.col("HAUT_SURPLOMB") < limits.clearance)))
    why = F.concat_ws("+", *[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests])
    return stations.withColumn("MOTIF_INAPTITUDE", why).withColumn("APTE_GRUMIER", F.col("MOTIF_INAPTITUDE") == "")


def trafficability_summary(judged: DataFrame, trace: str = "trace_id") -> DataFrame:
    """Per trace: stations, share that fits, and how many each criterion blocks."""
    counts = [
        F.count_if(F.array_contains(F.split("MOTIF_INAPTITUDE", r"\+"), n)).alias(f"n_{n}")
        for n in ("largeur", "pente", "rayon", "gabarit", "surplomb")
    ]
    return judged.groupBy(trace).agg(
        F.count("*").alias("n_stations"), F.round(F.avg(F.col("APTE_GRUMIER").cast("double")), 6).alias("part_apte"), *counts
    )


def islands(df: DataFrame, value: Column, trace: str = "trace_id", order: str = "station", out: str = "run") -> DataFrame:
    """Number the runs of equal values along each trace; null is a value of its own."""
    w = along(trace, order)
    before = F.lag("__v").over(w)
    new = F.row_number().over(w).eqNullSafe(1) | ~F.col("__v").eqNullSafe(before)
    marked = df.withColumn("__v", value).withColumn("__new", new.cast("int"))
    return marked.withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__v", "__new")


def passing_places(stations: DataFrame, margin: float = 2.0, length_min: float = 6.0, trace: str = "trace_id") -> DataFrame:
    """Runs at least ``margin`` wider than the trace's median and ``length_min`` long: one row at the first widest station."""
    median = stations.groupBy(trace).agg(F.median("LARGEUR_ROULABLE").alias("__m"))
    wide = F.coalesce(F.col("LARGEUR_ROULABLE") >= F.col("__m") + margin, F.lit(False))
    marked = islands(stations.join(median, trace).withColumn("__wide", wide), F.col("__wide"), trace)
    first = lambda col: F.min_by(col, F.struct(-F.col("LARGEUR_ROULABLE"), F.col("station")))
    return (
        marked.filter("__wide")
        .groupBy(trace, "run")
        .agg(first("chainage").alias("chainage"), (F.max("chainage") - F.min("chainage")).alias("longueur"),
             F.max("LARGEUR_ROULABLE").alias("largeur_max"), first("x").alias("x"), first("y").alias("y"))
        .filter(F.col("longueur") >= length_min)
        .drop("run")
    )


def smooth(col: str, width: int, trace: str = "trace_id", order: str = "station") -> Column:
    """Centred mean over ``width`` stations that ignores nulls and shrinks at the ends."""
    h = (width - 1) // 2
    return F.avg(col).over(along(trace, order).rowsBetween(-h, h))


def long_slope(z: str = "z", chainage: str = "chainage", trace: str = "trace_id") -> Column:
    """Mean of the gradients before and after a station; at an end the one there is."""
    w = along(trace)
    after = F.try_divide(F.lead(z).over(w) - F.col(z), F.lead(chainage).over(w) - F.col(chainage))
    before = F.try_divide(F.col(z) - F.lag(z).over(w), F.col(chainage) - F.lag(chainage).over(w))
    return F.when(after.isNull(), before).when(before.isNull(), after).otherwise((after + before) / 2)


def triple_radius(trace: str = "trace_id") -> Column:
    """Radius through a station and its neighbours; infinite at the ends."""
    w = along(trace)
    r = circumradius(F.lag("x").over(w), F.lag("y").over(w), "x", "y", F.lead("x").over(w), F.lead("y").over(w))
    return F.coalesce(F.when(F.lag("x").over(w).isNotNull() & F.lead("x").over(w).isNotNull(), r), F.lit(float("inf")))


def fitted_radius(stations: DataFrame, base: float = 30.0, trace: str = "trace_id", out: str = "RAYON_COURBURE") -> DataFrame:
    """Radius of the least-squares circle over ``base`` metres of chainage around each station.

    Sums of moments over a range frame give the normal equations of
    x2+y2 = 2ax + 2by + c; coordinates are taken from the trace's mean first.
    Fewer than four points or a singular system: infinite.
    """
    mean = Window.partitionBy(trace)
    # range frames take whole numbers: millimetres of chainage
    half = round(base * 500)
    w = Window.partitionBy(trace).orderBy(F.round(F.col("chainage") * 1000).cast("long")).rangeBetween(-half, half)
    u, v = F.col("__u"), F.col("__v")
    s = stations.withColumn("__u", F.col("x") - F.avg("x").over(mean)).withColumn("__v", F.col("y") - F.avg("y").over(mean)).withColumn("__q", u * u + v * v)
    terms = {"n": F.lit(1.0), "u": u, "v": v, "uu": u * u, "vv": v * v, "uv": u * v, "q": F.col("__q"), "uq": u * F.col("__q"), "vq": v * F.col("__q")}
    for k, t in terms.items():
        s = s.withColumn(f"__s{k}", F.sum(t).over(w))
    g = lambda k: F.col(f"__s{k}")
    # centred second moments
    n = g("n")
    cuu, cvv, cuv = g("uu") - g("u") * g("u") / n, g("vv") - g("v") * g("v") / n, g("uv") - g("u") * g("v") / n
    cuq, cvq = g("uq") - g("u") * g("q") / n, g("vq") - g("v") * g("q") / n
    det = cuu * cvv - cuv * cuv
    a, b = F.try_divide(cuq * cvv - cvq * cuv, 2 * det), F.try_divide(cvq * cuu - cuq * cuv, 2 * det)
    c0 = (g("q") - 2 * a * g("u") - 2 * b * g("v")) / n
    r = F.sqrt(c0 + a * a + b * b)
    fine = (n >= 4) & a.isNotNull() & (F.abs(det) > 1e-9 * F.greatest(cuu * cvv, F.lit(1e-9))) & (c0 + a * a + b * b > 0)
    return s.withColumn(out, F.when(fine, r).otherwise(float("inf"))).drop("__u", "__v", "__q", *[f"__s{k}" for k in terms])


def sinuosity(stations: DataFrame, trace: str = "trace_id") -> DataFrame:
    """Length over chord of each trace; null where the chord has no length."""
    w = along(trace)
    step = distance(F.lag("x").over(w), F.lag("y").over(w), "x", "y")
    ends = {f"{a}_{c}": f(c, "station") for a, f in (("first", F.min_by), ("last", F.max_by)) for c in ("x", "y")}
    sums = stations.withColumn("__d", step).groupBy(trace).agg(F.sum("__d").alias("longueur"), *[e.alias(k) for k, e in ends.items()])
    chord = distance("first_x", "first_y", "last_x", "last_y")
    return sums.withColumn("corde", chord).withColumn("sinuosite", F.when(F.col("corde") >= 1e-9, F.col("longueur") / F.col("corde"))).select(
        trace, "longueur", "corde", "sinuosite"
    )


def state_profile(stations: DataFrame, trace: str = "trace_id") -> DataFrame:
    """Append divergence and state code to stations with ``sigma_geo`` and ``sigma_surf``."""
    return stations.withColumn("divergence", F.col("sigma_geo") - F.col("sigma_surf")).withColumn("etat", state("sigma_geo", "sigma_surf"))


def state_runs(profile: DataFrame, trace: str = "trace_id") -> DataFrame:
    """Runs of one state along a trace: from the run's first station to the first of the next; null states are runs.

    The last station ends the last run and opens none.
    """
    w = along(trace)
    step = profile.withColumn("__next", F.lead("chainage").over(w))
    runs = islands(step.filter("__next is not null"), F.col("etat"), trace)
    return runs.groupBy(trace, "run").agg(
        F.first("etat").alias("etat"), F.min("chainage").alias("debut"), F.max("__next").alias("fin"), F.count("*").alias("n_sommets"),
        F.avg("sigma_geo").alias("sigma_geo"), F.avg("sigma_surf").alias("sigma_surf"),
    ).withColumn("longueur", F.col("fin") - F.col("debut")).withColumn("etat_label", state_label(F.col("etat")))


def state_summary(runs: DataFrame, trace: str = "trace_id") -> DataFrame:
    """Length and share of each state; null states count in the total and are not listed."""
    total = Window.partitionBy(trace)
    return (
        runs.groupBy(trace, "etat_label").agg(F.sum("longueur").alias("longueur"))
        .withColumn("pourcentage", F.round(100 * F.col("longueur") / F.sum("longueur").over(total), 1))
        .filter("etat_label is not null")
    )


def central_run(profiles: DataFrame, inside: Column, keys: tuple[str, ...] = ("trace_id", "station"), offset: str = "offset") -> DataFrame:
    """Width of the contiguous run of points that are inside and hold the profile's centre; 0 where the centre is out.

    Without interpolation: the span of the run's outermost offsets.
    """
    w = Window.partitionBy(*keys).orderBy(offset)
    marked = profiles.withColumn("__in", F.coalesce(inside, F.lit(False)))
    new = F.coalesce(F.col("__in") != F.lag("__in").over(w), F.lit(True)).cast("int")
    marked = marked.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    span = marked.groupBy(*keys, "__run").agg(
        F.first("__in").alias("__in"), F.min(offset).alias("gauche"), F.max(offset).alias("droite"), F.min(F.abs(offset)).alias("__c")
    )
    middle = F.min_by(F.struct("__in", "gauche", "droite"), F.struct("__c", "__run"))
    got = span.groupBy(*keys).agg(middle.alias("m"))
    hit = F.col("m.__in")
    return got.select(*keys, F.when(hit, F.col("m.droite") - F.col("m.gauche")).otherwise(0.0).alias("largeur"),
                      F.when(hit, F.col("m.gauche")).alias("gauche"), F.when(hit, F.col("m.droite")).alias("droite"))


def otsu(values: DataFrame, col: str = "v", bins: int = 256) -> DataFrame:
    """Threshold of greatest between-class variance: the midpoint of the first best bin, one row.

    The histogram is a grouped count; only its rows meet in the cumulative window.
    """
    edge = values.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    k = F.least(F.floor((F.col(col) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    hist = values.filter(F.col(col).isNotNull()).crossJoin(F.broadcast(edge)).filter("hi > lo").groupBy(k.alias("k"), "lo", "hi").agg(F.count("*").alias("n"))
    mid = F.col("lo") + (F.col("k") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    # a histogram of `bins` rows at most: one task is enough
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    h = hist.withColumn("mid", mid)
    h = h.withColumn("w0", F.sum("n").over(upto)).withColumn("s0", F.sum(F.col("n") * F.col("mid")).over(upto)).withColumn("w", F.sum("n").over(all_)).withColumn(
        "s", F.sum(F.col("n") * F.col("mid")).over(all_)
    )
    m0, m1 = F.col("s0") / F.col("w0"), (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    between = F.col("w0") * (F.col("w") - F.col("w0")) * (m0 - m1) * (m0 - m1)
    return h.filter("w0 < w").withColumn("between", between).agg(F.min_by("mid", F.struct(-F.col("between"), F.col("k"))).alias("seuil"))


def applicable_length(trace: str = "trace_id") -> Column:
    """Half the way to each neighbour; these sum up to the trace's length."""
    w = along(trace)
    before = F.coalesce(F.col("chainage") - F.lag("chainage").over(w), F.lit(0.0))
    after = F.coalesce(F.lead("chainage").over(w) - F.col("chainage"), F.lit(0.0))
    return (before + after) / 2
