"""Normative road widths by administrative class, nature, crossing and lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.geometry import c

# The published norm's table (class | nature | crossing | lanes |
# carriageway | stop lane | verge | buffer, metres).
NORM_TABLE = """
Autoroute|Autoroute|NC|0|3.5|3|1|12
Autoroute|Autoroute|NC|2|7|3|1|12
Autoroute|Autoroute|NC|3|10.5|3|1|12
Autoroute|Autoroute|NC|4|14|3|1|12
Autoroute|Autoroute|Pont|2|7|3|0|6.5
Autoroute|Autoroute|Pont|3|10.5|3|0|6.5
Autre|Bretelle|NC|0|3|2|1|4.5
Autre|Bretelle|NC|1|3|2|1|4.5
Autre|Bretelle|NC|2|6|2|1|6
Autre|Bretelle|Pont|0|3|2|0|3.5
Autre|Bretelle|Pont|1|3|2|0|3.5
Autre|Bretelle|Pont|2|6|2|0|5
Autre|Chemin|Gue ou radier|0|2|0|0|1
Autre|Chemin|NC|0|2|0|0|1
Autre|Chemin|Pont|0|2|0|0|1
Autre|Chemin|Tunnel|0|2|0|0|1
Autre|Escalier|NC|0|2|0|0|1
Autre|Escalier|Pont|0|2|0|0|1
Autre|Piste cyclable|NC|0|2|0|0|1
Autre|Piste cyclable|Pont|0|2|0|0|1
Autre|Piste cyclable|Tunnel|0|2|0|0|1
Autre|Route a 1 chaussee|Gue ou radier|0|2|0|0.75|1.75
Autre|Route a 1 chaussee|Gue ou radier|1|2|0|0.75|1.75
Autre|Route a 1 chaussee|Gue ou radier|2|4|0.5|0.75|3.25
Autre|Route a 1 chaussee|NC|0|2|0.5|0.75|3.25
Autre|Route a 1 chaussee|NC|1|2|0.5|0.75|3.25
Autre|Route a 1 chaussee|NC|2|4|0.5|0.75|3.25
Autre|Route a 1 chaussee|NC|3|6|0.5|0.75|3.25
Autre|Route a 1 chaussee|NC|4|8|0.5|0.75|3.25
Autre|Route a 1 chaussee|NC|5|10|0.5|0.75|3.25
Autre|Route a 1 chaussee|Pont|0|2|0.5|0|1.5
Autre|Route a 1 chaussee|Pont|1|2|0.5|0|1.5
Autre|Route a 1 chaussee|Pont|2|4|0.5|0|2.5
Autre|Route a 1 chaussee|Pont|3|6|0.5|0|2.5
Autre|Route a 1 chaussee|Pont|4|8|0.5|0|2.5
Autre|Route a 1 chaussee|Tunnel|0|2|0.5|0|1.5
Autre|Route a 1 chaussee|Tunnel|1|2|0.5|0|1.5
Autre|Route a 1 chaussee|Tunnel|2|4|0.5|0|2.5
Autre|Route a 2 chaussees|NC|0|2.5|1.5|1|4
Autre|Route a 2 chaussees|NC|1|2.5|1.5|1|4
Autre|Route a 2 chaussees|NC|2|5|1|1|4.5
Autre|Route a 2 chaussees|NC|3|7.5|1|1|4.5
Autre|Route a 2 chaussees|Pont|2|5|1|1|4.5
Autre|Route empierree|Gue ou radier|0|2|0|0|1
Autre|Route empierree|NC|0|2|0|0|1
Autre|Route empierree|Pont|0|2|0|0|1
Autre|Route empierree|Tunnel|0|2|0|0|1
Autre|Sentier|NC|0|2|0|0|1
Autre|Sentier|Pont|0|2|0|0|1
Autre|Sentier|Tunnel|0|2|0|0|1
Departementale|Bretelle|NC|0|3.5|1|1|3.75
Departementale|Bretelle|NC|1|3.5|1|1|3.75
Departementale|Bretelle|NC|2|7|1|1|5.5
Departementale|Bretelle|Pont|1|3.5|1|0|2.75
Departementale|Route a 1 chaussee|NC|0|3|0.5|1|3
Departementale|Route a 1 chaussee|NC|1|3|0.5|1|3
Departementale|Route a 1 chaussee|NC|2|6|1|1|5
Departementale|Route a 1 chaussee|NC|3|9|1|1|5
Departementale|Route a 1 chaussee|NC|4|12|1|1|5
Departementale|Route a 1 chaussee|Pont|0|3|0.5|0|2
Departementale|Route a 1 chaussee|Pont|1|3|0.5|0|2
Departementale|Route a 1 chaussee|Pont|2|6|1|0|4
Departementale|Route a 1 chaussee|Pont|3|9|1|0|4
Departementale|Route a 1 chaussee|Pont|4|12|1|0|4
Departementale|Route a 1 chaussee|Tunnel|2|6|1|0|4
Departementale|Route a 2 chaussees|NC|0|3.5|1.5|1|4.5
Departementale|Route a 2 chaussees|NC|1|3.5|1.5|1|4.5
Departementale|Route a 2 chaussees|NC|2|7|2.5|1|7
Departementale|Route a 2 chaussees|NC|3|10.5|2.5|1|7
Departementale|Route a 2 chaussees|Pont|0|3.5|1.5|0|3.5
Departementale|Route a 2 chaussees|Pont|1|3.5|1.5|0|3.5
Departementale|Route a 2 chaussees|Pont|2|7|2|0|5.5
Departementale|Route a 2 chaussees|Pont|3|10.5|2|0|5.5
Departementale|Route empierree|NC|0|0|0|0|1
Departementale|Sentier|NC|0|0|0|0|1
Nationale|Bretelle|NC|1|3.5|2.5|1|5.25
Nationale|Bretelle|NC|2|7|2.5|1|7
Nationale|Bretelle|Pont|1|3.5|2.5|0|4.25
Nationale|Quasi-autoroute|NC|1|3.5|2.5|1|5.25
Nationale|Quasi-autoroute|NC|2|7|2.5|1|7
Nationale|Quasi-autoroute|Pont|1|3.5|2.5|0|4.25
Nationale|Quasi-autoroute|Pont|2|7|2.5|0|6
Nationale|Route a 1 chaussee|NC|1|3.5|2.5|1|5.25
Nationale|Route a 1 chaussee|NC|2|7|2.5|1|7
Nationale|Route a 1 chaussee|NC|3|10.5|2.5|1|7
Nationale|Route a 1 chaussee|NC|4|14|2.5|1|7
Nationale|Route a 1 chaussee|Pont|1|3.5|2.5|0|4.25
Nationale|Route a 1 chaussee|Pont|2|7|2.5|0|6
Nationale|Route a 1 chaussee|Pont|3|10.5|2.5|0|6
Nationale|Route a 1 chaussee|Pont|4|14|2.5|0|6
Nationale|Route a 1 chaussee|Tunnel|2|7|2.5|0|6
Nationale|Route a 2 chaussees|NC|0|3.5|2.5|1|7
Nationale|Route a 2 chaussees|NC|1|3.5|2.5|1|5.25
Nationale|Route a 2 chaussees|NC|2|7|2.5|1|7
Nationale|Route a 2 chaussees|NC|3|10.5|2.5|1|7
Nationale|Route a 2 chaussees|Pont|1|3.5|2.5|0|4.25
Nationale|Route a 2 chaussees|Pont|2|7|2.5|0|6
"""

# Natures of the third schema in terms of the second.
NATURE_V3 = {
    "Type autoroutier": "Autoroute",
    "Rond-point": "Route a 1 chaussee",
    "Route a 1 chaussee": "Route a 1 chaussee",
    "Route a 2 chaussees": "Route a 2 chaussees",
    "Route empierree": "Route empierree",
}

# Column names under which each field is known.
ALIASES = {
    "cl_admin": ["cl_admin", "classe_administrative", "cpx_classement_administratif", "classement_administratif"],
    "nature": ["nature"],
    "franchissement": ["franchisst", "franchissement"],
    "nb_voies": ["nb_voies", "nombre_de_voies"],
    "pos_sol": ["pos_sol", "position_par_rapport_au_sol"],
}

# Accented letters and what they become.
ACCENTED, PLAIN = "àâäçéèêëîïôöùûüÀÂÄÇÉÈÊËÎÏÔÖÙÛÜ", "aaaceeeeiioouuuAAACEEEEIIOOUUU"


def plain_label(col) -> Column:
    """Labels without accents, runs of other signs as one space, lower case, trimmed."""
    return F.trim(F.lower(F.regexp_replace(F.translate(c(col), ACCENTED, PLAIN), "[^A-Za-z0-9]+", " ")))


def norm_table(spark: SparkSession) -> DataFrame:
    rows = [r.split("|") for r in NORM_TABLE.strip().splitlines()]
    typed = [(a, b, x, int(n), *map(float, w)) for a, b, x, n, *w in rows]
    schema = "cl_admin string, nature string, franchissement string, nb_voies int, largeur_corrigee double, largeur_bande_arret double, largeur_berme double, largeur_buffer double"
    return spark.createDataFrame(typed, schema)


def fields_of(columns: list[str], given: dict[str, str] | None = None) -> dict[str, str | None]:
    """Columns of the norm's fields, whatever their case; ``given`` completes what is found."""
    by_lower = {x.lower(): x for x in columns}
    found = {f: next((by_lower[a] for a in names if a in by_lower), None) for f, names in ALIASES.items()}
    for f, name in (given or {}).items():
        if f not in found:
            raise ValueError(f"unknown field {f}; known are {sorted(found)}")
        if name is not None and name.lower() not in by_lower:
            raise ValueError(f"no column {name}")
        found[f] = by_lower.get(name.lower()) if name is not None else None
    missing = [f for f in ("cl_admin", "nature", "nb_voies") if found[f] is None]
    if missing:
        raise ValueError(f"fields not found: {missing}")
    return found


def normative_widths(segments: DataFrame, schema: str = "auto", fields: dict[str, str] | None = None, natures: dict[str, str] | None = None) -> DataFrame:
    """Append the norm's widths by a left join on four keys; what has no match stays null.

    Missing lanes count as zero. The crossing comes from its own column, or
    from the position above ground (below: tunnel; above: bridge).
    """
    f = fields_of(segments.columns, fields)
    if schema == "auto":
        schema = "v2" if f["franchissement"] else "v3" if f["pos_sol"] else "v2"
    lanes = F.coalesce(F.col(f["nb_voies"]).try_cast("int"), F.lit(0))
    if f["franchissement"]:
        cross = F.coalesce(F.when(F.col(f["franchissement"]) != "", F.col(f["franchissement"])), F.lit("NC"))
    elif f["pos_sol"]:
        p = F.col(f["pos_sol"]).try_cast("double")
        cross = F.when(p < 0, "Tunnel").when(p > 0, "Pont").otherwise("NC")
    else:
        cross = F.lit("NC")
    nature = plain_label(f["nature"])
    mapped = natures if natures is not None else (NATURE_V3 if schema == "v3" else {})
    if mapped:
        pairs = [F.lit(x) for k, v in mapped.items() for x in (_plain(k), _plain(v))]
        nature = F.coalesce(F.element_at(F.create_map(*pairs), nature), nature)
    keyed = segments.withColumn("__cl", plain_label(f["cl_admin"])).withColumn("__na", nature).withColumn("__fr", plain_label(cross)).withColumn("__nv", lanes)
    norm = norm_table(segments.sparkSession).select(
        plain_label("cl_admin").alias("__cl"), plain_label("nature").alias("__na"), plain_label("franchissement").alias("__fr"), F.col("nb_voies").alias("__nv"),
        F.col("largeur_corrigee").alias("LARGEUR_CHAUSSEE_CERTU"), F.col("largeur_bande_arret").alias("BANDE_ARRET_CERTU"),
        F.col("largeur_berme").alias("BERME_CERTU"), (2 * F.col("largeur_buffer")).alias("LARGEUR_EMPRISE_CERTU"),
    )
    # the norm has fewer than a hundred rows
    return keyed.join(F.broadcast(norm), ["__cl", "__na", "__fr", "__nv"], "left").drop("__cl", "__na", "__fr", "__nv")


def _plain(s: str) -> str:
    import re

    return re.sub("[^A-Za-z0-9]+", " ", s.translate(str.maketrans(ACCENTED, PLAIN))).lower().strip()


def unmatched(widths: DataFrame, keys: list[str]) -> DataFrame:
    """Combinations without a norm and how often they come."""
    return widths.filter("LARGEUR_CHAUSSEE_CERTU is null").groupBy(*keys).agg(F.count("*").alias("n"))


def norm_gap(stations: DataFrame, norm: DataFrame, id_col: str = "troncon", measured: str = "LARGEUR_ROULABLE", wanted: str = "LARGEUR_CHAUSSEE_CERTU") -> DataFrame:
    """Per segment: stations, median width, norm (the least where a segment has several), gap, relative gap (null for a norm of zero), share of stations with a resolved edge."""
    edge = F.avg((F.col("BORDS_CHAUSSEE") > 0).cast("double")) if "BORDS_CHAUSSEE" in stations.columns else F.lit(None).cast("double")
    per = stations.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("N_STATIONS"), F.median(measured).alias("LARGEUR_MED"), edge.alias("BORDS_RESOLUS"))
    first = norm.groupBy(id_col).agg(F.min(wanted).alias("LARGEUR_NORME"))
    gap = F.col("LARGEUR_MED") - F.col("LARGEUR_NORME")
    return per.join(first, id_col, "left").withColumn("ECART_NORME", gap).withColumn(
        "ECART_REL", F.when(F.col("LARGEUR_NORME") != 0, F.col("ECART_NORME") / F.col("LARGEUR_NORME"))
    )
