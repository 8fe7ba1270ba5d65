"""Domain views over the driver's tables, in SQL that Spark and DuckDB both read.

Sums are over integers (cents, hundredths), so values don't depend on the
order in which an engine adds.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "v_points": """
SELECT CAST(l_partkey % 64 AS INT) AS row, CAST(l_suppkey % 64 AS INT) AS col, l_quantity / 5.0 AS h,
  CASE WHEN l_returnflag = 'A' THEN 2 WHEN l_returnflag = 'N' THEN 5 WHEN l_linenumber = 1 THEN 17 WHEN l_linenumber = 2 THEN 6 ELSE 1 END AS cls,
  l_partkey % 64 + 0.25 AS x, 64 - l_suppkey % 64 - 0.75 AS y
FROM lineitem""",
    "v_cells": """
SELECT CAST(l_partkey % 64 AS INT) AS row, CAST(l_suppkey % 64 AS INT) AS col,
  sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / (count(*) * 100000.0E0) AS z,
  sum(CAST(round(l_discount * 100) AS BIGINT)) / (count(*) * 10.0E0) AS rugosite,
  sum(CAST(round(l_tax * 100) AS BIGINT)) / (count(*) * 8.0E0) AS vesselness,
  sum(CAST(l_quantity AS BIGINT)) / (count(*) * 50.0E0) AS taux_penetration,
  CAST(min(l_orderkey) % 100 AS DOUBLE) AS densite_sousetage
FROM lineitem GROUP BY CAST(l_partkey % 64 AS INT), CAST(l_suppkey % 64 AS INT)""",
    "v_ground": """
SELECT CAST(floor(o_orderkey / 64) AS INT) AS row, CAST(o_orderkey % 64 AS INT) AS col, (CAST(round(o_totalprice * 100) AS BIGINT) % 1000) / 1000.0E0 AS sigma,
  CASE WHEN o_orderkey % 64 % 21 < 5 OR floor(o_orderkey / 64) % 17 < 4 OR o_custkey % 29 = 0 THEN CASE WHEN o_custkey % 31 = 0 THEN 0 ELSE 1 END ELSE 0 END AS route,
  CAST(round(o_totalprice * 100) AS BIGINT) % 7919 / 100.0E0 AS z
FROM orders""",
    "v_stations": """
SELECT user_id AS trace_id, CAST(k AS INT) AS station, 2.0E0 * (k - 1) AS chainage,
  2.0E0 * k + (event_id * 7919 % 200) / 100.0E0 AS x, (event_id * 104729 % 1000) / 50.0E0 AS y, value / 8.0E0 AS z,
  value / 80.0E0 AS LARGEUR_ROULABLE, (event_id % 41 - 20) / 125.0E0 AS PENTE_LONG,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value / 8.0E0 END AS RAYON_COURBURE,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 13 AS DOUBLE) END AS GABARIT_LIBRE,
  CASE WHEN event_id % 4 = 0 THEN 1.5E0 ELSE 0.0E0 END AS SURPLOMB, CAST(event_id % 9 AS DOUBLE) AS HAUT_SURPLOMB,
  CAST(event_id % 3 AS INT) AS BORDS_CHAUSSEE, CAST(event_id % 4 AS INT) AS FOSSES,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE (event_id % 100) / 100.0E0 END AS sigma_geo, (event_id * 37 % 100) / 100.0E0 AS sigma_surf
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) AS e""",
    "v_profiles": """
SELECT user_id AS trace_id, CAST(floor((k - 1) / 17) AS INT) AS station, CAST((k - 1) % 17 AS INT) AS k, ((k - 1) % 17 - 8) * 0.5E0 AS off,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE value / 50.0E0 END AS z
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) + 1 AS k FROM events) AS e""",
    "v_traces": """
SELECT c_custkey AS trace_id, 4.25E0 + c_custkey * 37 % 56 AS x1, 4.5E0 + c_custkey * 91 % 56 AS y1, 4.62E0 + c_custkey * 37 % 56 + c_custkey * 13 % 21 - 10 AS x2, 4.81E0 + c_custkey * 91 % 56 + c_custkey * 17 % 19 - 9 AS y2,
  5.3E0 + c_custkey * 37 % 56 + c_custkey * 13 % 21 - 10 + c_custkey * 7 % 17 - 8 AS x3, 5.7E0 + c_custkey * 91 % 56 + c_custkey * 17 % 19 - 9 + c_custkey * 11 % 15 - 7 AS y3
FROM customer""",
    "v_segments": """
SELECT o_orderkey AS id, CAST(o_orderkey * 37 % 5000 AS DOUBLE) AS x1, CAST(o_custkey * 91 % 5000 AS DOUBLE) AS y1,
  CAST(o_orderkey * 37 % 5000 + o_orderkey * 13 % 61 - 30 AS DOUBLE) AS x2, CAST(o_custkey * 91 % 5000 + o_custkey * 17 % 41 + 1 AS DOUBLE) AS y2,
  CASE WHEN o_orderstatus = 'F' THEN 'Autre' WHEN o_orderstatus = 'O' THEN 'Départementale' ELSE 'Nationale' END AS cl_admin,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Route à 1 chaussée' WHEN o_orderpriority = '2-HIGH' THEN 'Route empierrée'
       WHEN o_orderpriority = '3-MEDIUM' THEN 'Chemin' WHEN o_orderpriority = '5-LOW' THEN 'Bretelle' ELSE 'Inconnue' END AS nature,
  CASE WHEN o_orderkey % 10 = 0 THEN 'Pont' WHEN o_orderkey % 10 = 1 THEN 'Tunnel' WHEN o_orderkey % 10 = 2 THEN '' ELSE 'NC' END AS franchisst,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS INT) END AS nb_voies
FROM orders""",
    "v_tiles": """
SELECT concat('/data/LHD_FXX_', lpad(CAST(o_custkey % 40 AS VARCHAR(9)), 4, '0'), '_', lpad(CAST(o_orderkey % 50 AS VARCHAR(9)), 4, '0'),
    CASE WHEN o_orderstatus = 'F' THEN '_PTS_C.copc.laz' WHEN o_orderstatus = 'O' THEN '_MNT_O.tif' ELSE '_MNH_O.tif' END) AS path,
  CASE WHEN o_orderstatus = 'F' THEN 'laz' WHEN o_orderstatus = 'O' THEN 'mnt' ELSE 'mnh' END AS type
FROM orders UNION ALL SELECT concat('/data/autre_', p_name, '.laz') AS path, 'laz' AS type FROM part""",
    "v_criteria": """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS reference, o_orderkey % 7 < 3 AS peigne,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 5 < 3 END AS minerale,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 11 < 3 END AS fosses, CAST(NULL AS BOOLEAN) AS connecte,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 4 = 1 END AS parcelle, o_orderkey % 13 < 4 AS crete
FROM orders""",
    "v_responses": """
SELECT page_id AS id, CASE page_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 429 WHEN 2 THEN 504 WHEN 3 THEN 500 ELSE 200 END AS status_code,
  CASE page_id % 9 WHEN 4 THEN substr(html, 1, 60) WHEN 5 THEN concat(html, '<remark> runtime error: Query timed out </remark>')
    WHEN 6 THEN concat(html, '<remark>out of memory</remark>') ELSE html END AS content,
  CASE WHEN page_id % 9 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 'Timeout was reached' ELSE 'Could not resolve host' END END AS error,
  CASE WHEN page_id % 9 = 1 THEN concat('Retry-After: ', CAST(page_id % 20 AS VARCHAR(9))) ELSE '' END AS headers
FROM pages""",
    "v_scores": """
SELECT d.doc_id AS id, CAST(n_chars % 97 AS DOUBLE) AS score, CAST(n_chars AS DOUBLE) AS size, quality AS y, lang AS massif
FROM documents AS d JOIN labels AS l ON d.doc_id = l.doc_id""",
}


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Frames of the named views over the Parquet tables of ``sf_dir``."""
    out = []
    for name in names:
        text = SQL[name]
        sources = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _tables(text)}
        marked = text
        for t in sources:
            marked = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", marked)
        out.append(spark.sql(marked, **sources))
    return out


def _tables(text: str) -> list[str]:
    known = "region nation customer supplier part orders lineitem events documents pages labels".split()
    return sorted({t for t in re.findall(r"\b(?:FROM|JOIN) (\w+)", text) if t in known})


def with_views(body: str, *names: str) -> str:
    """DuckDB text that begins with the named views; ``body`` goes on with more CTEs or a SELECT."""
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
    lead = body.lstrip()
    if lead[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes}, {lead[15:]}"
    return f"WITH {ctes}, {lead[5:]}" if lead[:5].upper() == "WITH " else f"WITH {ctes}\n{lead}"
