"""Classes and map tags of detected lines from three-valued criteria."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators.network import nearest_feature

# Tags of each class.
TAGS = {
    "route_forestiere": "highway=track;tracktype=grade2;surface=compacted",
    "piste_forestiere": "highway=track;tracktype=grade4;surface=ground",
    "desserte": "highway=track",
    "cloisonnement_exploitation": "man_made=cutline;cutline=loggingmachine",
    "pare_feu": "man_made=cutline;cutline=firebreak",
}
CRITERIA = ("reference", "peigne", "minerale", "fosses", "connecte", "parcelle", "crete")


def classify(edges: DataFrame, boundary: str = "section") -> DataFrame:
    """Append class, confidence, reasons and tags.

    ``edges`` has the criteria as booleans; a missing column is unknown. The
    rules are tried from the strongest: what counts as built (in the
    reference, or ditched) by its surface, then firebreak, parcel line,
    logging corridor. Confidence is the share of criteria that are known.
    """
    has = set(edges.columns)
    v = {k: F.col(k).cast("boolean") if k in has else F.lit(None).cast("boolean") for k in CRITERIA}
    yes = lambda k: F.coalesce(v[k], F.lit(False))
    no = lambda k: F.coalesce(~v[k], F.lit(False))
    built = yes("reference") | yes("fosses")
    kind = (
        F.when(built & yes("minerale"), "route_forestiere")
        .when(built & no("minerale"), "piste_forestiere")
        .when(built, "desserte")
        .when(yes("crete") & no("minerale"), "pare_feu")
        .when(yes("parcelle") & ~yes("minerale"), "layon_parcellaire")
        .when(yes("peigne") & ~yes("minerale") & ~yes("fosses"), "cloisonnement_exploitation")
        .otherwise("indetermine")
    )
    said = [F.when(v[k].isNull(), f"{k}?").when(v[k], k).otherwise(f"!{k}") for k in CRITERIA]
    known = sum((v[k].isNotNull().cast("int") for k in CRITERIA), F.lit(0))
    tags = F.when(F.col("CLASSE") == "layon_parcellaire", f"man_made=cutline;cutline={boundary}")
    for name, tag in TAGS.items():
        tags = tags.when(F.col("CLASSE") == name, tag)
    return edges.withColumn("CLASSE", kind).withColumn("CLASSE_CONF", known / len(CRITERIA)).withColumn("CLASSE_MOTIF", F.concat_ws("+", *said)).withColumn("OSM_TAGS", tags)


def ditch_criterion(stations: DataFrame, share: float = 0.2, id_col: str = "id") -> DataFrame:
    """Whether ``share`` of a line's stations have a ditch."""
    return stations.filter("FOSSES is not null").groupBy(id_col).agg((F.avg((F.col("FOSSES") > 0).cast("double")) >= share).alias("fosses"))


def attested_access(edges: DataFrame, signs: DataFrame, reach: float = 15.0, id_col: str = "id") -> DataFrame:
    """Add access tags that signs within ``reach`` attest: one value only, with its source; contradiction is a reason, not a tag."""
    pts = signs.withColumn("pid", F.monotonically_increasing_id()).withColumn("source", F.col("source") if "source" in signs.columns else F.lit(None).cast("string"))
    near = near_all(pts.select("pid", "x", "y", "access", "source"), edges.select(F.col(id_col).alias("__e"), "x1", "y1", "x2", "y2"), reach)
    filled = lambda k: F.array_sort(F.collect_set(F.when(F.col(k) != "", F.col(k))))
    per = near.groupBy("__e").agg(filled("access").alias("__a"), filled("source").alias("__s"))
    one = F.size("__a") == 1
    src = F.when(F.size("__s") == 1, F.col("__s")[0]).otherwise("survey")
    more = F.concat(F.lit("access="), F.col("__a")[0], F.lit(";source:access="), src)
    done = edges.join(per, F.col(id_col) == F.col("__e"), "left")
    return (
        done.withColumn("OSM_TAGS", F.when(one, F.concat_ws(";", "OSM_TAGS", more)).otherwise(F.col("OSM_TAGS")))
        .withColumn("CLASSE_MOTIF", F.when(one, F.concat("CLASSE_MOTIF", F.lit("+acces_atteste"))).when(F.col("__e").isNotNull(), F.concat("CLASSE_MOTIF", F.lit("+acces_contradictoire"))).otherwise(F.col("CLASSE_MOTIF")))
        .drop("__e", "__a", "__s")
    )


def near_all(points: DataFrame, segments: DataFrame, reach: float) -> DataFrame:
    """All pairs of a point and a segment within ``reach``, by squares."""
    from timberline.functions.geometry import point_segment_distance

    side = F.lit(float(reach))
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - side) / side).cast("long"), F.floor((F.greatest(a, b) + side) / side).cast("long"))
    listed = segments.withColumn("__gx", F.explode(span(F.col("x1"), F.col("x2")))).withColumn("__gy", F.explode(span(F.col("y1"), F.col("y2"))))
    placed = points.withColumn("__gx", F.floor(F.col("x") / side).cast("long")).withColumn("__gy", F.floor(F.col("y") / side).cast("long"))
    return placed.join(listed, ["__gx", "__gy"]).filter(point_segment_distance("x", "y", "x1", "y1", "x2", "y2") <= reach).drop("__gx", "__gy")


__all__ = ["CRITERIA", "TAGS", "attested_access", "classify", "ditch_criterion", "near_all", "nearest_feature"]
