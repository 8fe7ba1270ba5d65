"""Learning and calibration over labelled cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.operators.cells import Rule, base_name, near_segments
from timberline.plans.ranks import hash_rank, quantiles, running_sum
from timberline.session import materialize, release


def auc(scored: DataFrame, score: str = "score", label: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve by average ranks; null where a class is missing.

    Scores are counted first, so ranks are a running sum over distinct
    values, in slices. ``by`` gives one area for each group.
    """
    counts = scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(
        F.count("*").alias("c"), F.sum(F.col(label).cast("long")).alias("p")
    )
    ranked = running_sum(counts, list(by), score, "c", "__c").withColumn("mid", F.col("__c") - F.col("c") + (F.col("c") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum(F.col("p") * F.col("mid")).alias("r"), F.sum("p").alias("np"), (F.sum("c") - F.sum("p")).alias("nn"))
    area = (F.col("r") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * F.col("nn"))
    return sums.select(*by, F.when((F.col("np") > 0) & (F.col("nn") > 0), area).alias("auc"))


def folds(rows: DataFrame, label: str = "y", key: str = "id", k: int = 5, seed: int = 1) -> DataFrame:
    """Stratified folds 1 to k: by class, in the order of a hash of the key."""
    ranked = hash_rank(rows, [label], F.xxhash64(F.lit(seed), F.col(key)), "__r")
    return ranked.withColumn("pli", (F.pmod(F.col("__r") - 1, F.lit(k)) + 1).cast("int")).drop("__r")


def sample_cells(cells: DataFrame, positives: DataFrame, channels: list[str], near: float = 3.0, far: float = 25.0, n_max: int = 20_000,
                 negatives: DataFrame | None = None, balanced: bool = True, seed: int = 1) -> DataFrame:
    """Labelled sample: cells within ``near`` of a positive line, and cells beyond ``far`` of all (or near given negatives).

    Only complete cells; with ``balanced`` the same number of either class,
    ``n_max`` together at most, chosen by a hash of the cell.
    """
    whole = cells.dropna(subset=channels).select("row", "col", "x", "y", *channels)
    on = near_segments(whole.select("x", "y"), positives, near)
    close = near_segments(whole.select("x", "y"), positives, far)
    off = near_segments(whole.select("x", "y"), negatives, near) if negatives is not None else whole.select("x", "y").join(close, ["x", "y"], "left_anti")
    off = off.join(on, ["x", "y"], "left_anti")
    both = on.withColumn("label", F.lit(1)).union(off.withColumn("label", F.lit(0)))
    rows = whole.join(both, ["x", "y"])
    if not balanced:
        return rows
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n = min(counts.get(0, 0), counts.get(1, 0), n_max // 2)
    return hash_rank(rows, ["label"], F.xxhash64(F.lit(seed), "row", "col"), "__r").filter(F.col("__r") <= n).drop("__r")


@dataclass
class LearnedConductivity:
    """A fitted probability of road, with the figures that came with it."""

    model: object
    method: str
    channels: list[str]
    auc_cv: float | None
    auc_fit: float | None
    n: int
    prevalence: float
    k: int

    def __str__(self) -> str:
        cv = "none" if self.auc_cv is None else f"{self.auc_cv:.3f}"
        return f"{self.method} on {', '.join(self.channels)}: {self.n} cells, prevalence {self.prevalence:.2f}, AUC {cv} in {self.k} folds"


def _estimator(method: str, seed: int):
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier

    if method == "glm":
        return LogisticRegression(featuresCol="__features", labelCol="label", regParam=0.0, maxIter=50)
    if method == "forest":
        return RandomForestClassifier(featuresCol="__features", labelCol="label", numTrees=100, seed=seed)
    raise ValueError(f"unknown method: {method}")


def learn_conductivity(sample: DataFrame, channels: list[str], method: str = "glm", k: int = 5, seed: int = 1) -> LearnedConductivity:
    """Logistic regression or forest; cross-validated area only where each class has ``k`` rows at least."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    data = materialize(sample.withColumn("__key", F.xxhash64("row", "col")).withColumn("label", F.col("label").cast("double")))
    counts = {int(r["label"]): r["count"] for r in data.groupBy("label").count().collect()}
    n = sum(counts.values())
    pipe = Pipeline(stages=[VectorAssembler(inputCols=channels, outputCol="__features"), _estimator(method, seed)])
    area = lambda df: auc(df.withColumn("score", road_probability()), "score", "label").first()["auc"]
    cv = None
    if min(counts.get(0, 0), counts.get(1, 0)) >= k:
        dealt = materialize(folds(data, "label", "__key", k, seed))
        held = None
        for f in range(1, k + 1):
            part = pipe.fit(dealt.filter(F.col("pli") != f)).transform(dealt.filter(F.col("pli") == f))
            held = part if held is None else held.union(part)
        cv = area(held)
        release(dealt)
    fitted = pipe.fit(data)
    own = area(fitted.transform(data))
    release(data)
    return LearnedConductivity(fitted, method, channels, cv, own, n, counts.get(1, 0) / max(n, 1), k)


def road_probability() -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array("probability")[1]


def predict_conductivity(cells: DataFrame, model: LearnedConductivity, sigma_min: float = 0.05, out: str = "sigma_geo") -> DataFrame:
    """Append the clamped probability; incomplete cells get null, a missing channel is an error."""
    missing = [c for c in model.channels if c not in cells.columns]
    if missing:
        raise ValueError(f"missing channels: {missing}")
    done = model.model.transform(cells.dropna(subset=model.channels)).withColumn(out, F.greatest(F.lit(sigma_min), F.least(F.lit(1.0), road_probability())))
    return cells.join(done.select("row", "col", out), ["row", "col"], "left")


def channel_areas(cells: DataFrame, bands: list[str], block: str = "massif", n_min: int = 50) -> DataFrame:
    """How well each band tells presence (``presence`` = 1) from absence (0), by block.

    Area turned to the right side with its sign, quartiles of presence and
    median of absence; null where a class has fewer than ``n_min`` cells.
    """
    long = cells.select(block, "presence", F.explode(F.map_from_arrays(F.array(*map(F.lit, bands)), F.array(*map(F.col, bands)))).alias("canal", "v"))
    long = long.filter("v is not null and presence is not null")
    areas = auc(long, "v", "presence", (block, "canal"))
    at = lambda y, q: F.percentile(F.when(F.col("presence") == y, F.col("v")), F.lit(q))
    facts = long.groupBy(block, "canal").agg(
        F.count_if(F.col("presence") == 1).alias("n_pres"), F.count_if(F.col("presence") == 0).alias("n_abs"),
        at(1, 0.25).alias("q25_pres"), at(1, 0.75).alias("q75_pres"), at(0, 0.5).alias("q50_abs"),
    )
    enough = (F.col("n_pres") >= n_min) & (F.col("n_abs") >= n_min)
    return facts.join(areas, [block, "canal"]).select(
        block, "canal", "n_pres", "n_abs", "q25_pres", "q75_pres", "q50_abs",
        F.when(enough, F.greatest("auc", 1 - F.col("auc"))).alias("auc"), F.when(enough, F.when(F.col("auc") >= 0.5, 1).otherwise(-1)).alias("sens"),
    )


def rule_bounds(sign, q25_pres, q75_pres, q50_abs) -> tuple[Column, Column]:
    """Bounds of a ramp from quantiles; null where they would not rise."""
    up = F.col(sign) > 0
    a, b = F.when(up, F.col(q50_abs)).otherwise(F.col(q25_pres)), F.when(up, F.col(q75_pres)).otherwise(F.col(q50_abs))
    return F.when(b > a, a), F.when(b > a, b)


def calibrate(areas: DataFrame, auc_min: float = 0.55, weight_max: float = 3.0, block: str = "massif") -> DataFrame:
    """One row a channel: median area over blocks, whether all blocks agree on the sign, weight, bounds, kept or not."""
    agg = areas.filter("auc is not null").groupBy("canal").agg(
        F.median("auc").alias("auc"), F.count_distinct("sens").alias("n_sens"), F.min("sens").alias("s"), F.count(block).alias("n_massifs"),
        F.median("q25_pres").alias("q25"), F.median("q75_pres").alias("q75"), F.median("q50_abs").alias("q50"),
    )
    stable = F.col("n_sens") == 1
    kept = stable & (F.col("auc") >= auc_min)
    excess = F.when(kept, F.col("auc") - 0.5)
    # one row a channel: a window over all of them is small
    done = agg.withColumn("stable", stable).withColumn("sens", F.when(stable, F.col("s"))).withColumn("retenu", kept).withColumn("excess", excess)
    top = F.max("excess").over(Window.partitionBy(F.lit(0)))
    a, b = rule_bounds("sens", "q25", "q75", "q50")
    weight = F.when(F.col("retenu"), F.greatest(F.lit(1.0), F.bround(weight_max * F.col("excess") / top)))
    return done.withColumn("poids", weight).select("canal", "n_massifs", "auc", "stable", "sens", "retenu", "poids", F.when(F.col("retenu"), a).alias("a"), F.when(F.col("retenu"), b).alias("b"))


def labelled_cells(cells: DataFrame, reference: DataFrame, bands: list[str], present: float = 3.0, absent: float = 20.0, n: int = 2_500, seed: int = 1) -> DataFrame:
    """Cells within ``present`` of the reference (1) and beyond ``absent`` of it (0), ``n`` of each at most by a hash of the cell.

    Cells need not be complete: a band is judged where it has a value.
    """
    if present >= absent:
        raise ValueError("present must be below absent")
    spots = cells.select("x", "y")
    on, close = near_segments(spots, reference, present), near_segments(spots, reference, absent)
    both = on.withColumn("presence", F.lit(1)).union(spots.join(close, ["x", "y"], "left_anti").withColumn("presence", F.lit(0)))
    rows = cells.select("row", "col", "x", "y", *bands).join(both, ["x", "y"])
    return hash_rank(rows, ["presence"], F.xxhash64(F.lit(seed), "row", "col"), "__r").filter(F.col("__r") <= n).drop("__r")


def calibrate_specs(blocks: list[tuple[DataFrame, DataFrame]], present: float = 3.0, absent: float = 20.0, auc_min: float = 0.55, weight_max: float = 3.0, n: int = 2_500,
                    exclude: tuple[str, ...] = ("theta",), bounded: bool = True, seed: int = 1, n_min: int = 50) -> dict:
    """Rules of conductivity from blocks of ``(cells, reference segments)``.

    A channel is the mean over its scales. ``specs``: rules of the channels
    kept (without bounds unless ``bounded``); ``diagnostic``: one row a channel; ``par_massif``: areas by block;
    ``terrain``: facts of each block that has the bands for them.
    """
    areas, terrain = None, None
    for k, (cells, reference) in enumerate(blocks, 1):
        held = [c for c in cells.columns if c not in ("row", "col", "x", "y")]
        names = [b for b in channel_bases(held) if b not in exclude]
        scales = {b: [F.col(c) for c in held if base_name(c) == b] for b in names}
        means = cells.select("row", "col", "x", "y", *[(sum(v[1:], v[0]) / len(v)).alias(b) for b, v in scales.items()])
        sample = labelled_cells(means, reference, names, present, absent, n, seed).withColumn("massif", F.lit(k))
        one = channel_areas(sample, names, n_min=n_min)
        areas = one if areas is None else areas.unionByName(one)
        if {"pente", "rugosite", "slrm_5"} <= set(held):
            facts = terrain_facts(cells).withColumn("massif", F.lit(k))
            terrain = facts if terrain is None else terrain.unionByName(facts)
    areas = materialize(areas)
    if areas.filter("auc is not null").isEmpty():
        raise ValueError("no channel can be measured: look at the reference")
    diagnostic = materialize(calibrate(areas, auc_min, weight_max)).orderBy(F.col("auc").desc(), "canal")
    rules = rules_from(diagnostic)
    if not bounded:
        rules = {k: Rule(v.kind, v.weight) for k, v in rules.items()}
    return {"specs": rules, "diagnostic": diagnostic, "par_massif": areas, "terrain": terrain}


def rules_from(calibrated: DataFrame) -> dict[str, Rule]:
    """Rules of the channels kept; a handful of rows come to the driver."""
    return {r["canal"]: Rule("up" if r["sens"] > 0 else "down", r["poids"], r["a"], r["b"]) for r in calibrated.filter("retenu").collect()}


def channel_bases(bands: list[str]) -> list[str]:
    return sorted({base_name(b) for b in bands} - {"theta"})


def terrain_facts(cells: DataFrame, slope: str = "pente", rough: str = "rugosite", relief: str = "slrm_5") -> DataFrame:
    """Median and 90th percentile of slope, median roughness, interquartile range of relief."""
    q = quantiles(cells, {slope: [0.5, 0.9], rough: [0.5], relief: [0.25, 0.75]})
    spread = None if q[relief][0] is None else q[relief][1] - q[relief][0]
    return cells.sparkSession.createDataFrame([(*q[slope], *q[rough], spread)], "pente_mediane double, pente_p90 double, rugosite_mediane double, slrm_iqr double")


def errors(pairs: DataFrame, measured: str, reference: str, by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Number, bias, mean absolute and root mean square error, and medians of both; a row counts ``weight`` (a whole number) times."""
    e = F.col(measured) - F.col(reference)
    some = pairs.filter(F.col(measured).isNotNull() & F.col(reference).isNotNull())
    if weight is not None:
        w = F.col(weight)
        mean = lambda v: F.sum(v * w) / F.sum(w)
        return some.groupBy(*by).agg(F.coalesce(F.sum(w), F.lit(0)).alias("n"), mean(e).alias("biais"), mean(F.abs(e)).alias("mae"), F.sqrt(mean(e * e)).alias("rmse"),
                                     F.percentile(measured, F.lit(0.5), w).alias("mediane_mesure"), F.percentile(reference, F.lit(0.5), w).alias("mediane_reference"))
    return some.groupBy(*by).agg(F.count("*").alias("n"), F.avg(e).alias("biais"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                                 F.median(measured).alias("mediane_mesure"), F.median(reference).alias("mediane_reference"))


def strata(col: str, cuts: tuple[float, ...] = (0.0, 2.0, 5.0, float("inf"))) -> Column:
    """Right-closed classes; the first includes its lower bound."""
    out = None
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        test = ((F.col(col) >= a) if k == 0 else (F.col(col) > a)) & (F.col(col) <= b)
        name = f"{'[' if k == 0 else '('}{a:g},{b:g}]"
        out = F.when(test, name) if out is None else out.when(test, name)
    return out
