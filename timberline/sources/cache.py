"""Cached layers with the parameters they were made with."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

POLICIES = ("reacquerir", "avertir", "echouer", "ignorer")
log = logging.getLogger(__name__)


def paths(folder: str, layer: str) -> tuple[str, str]:
    """Of the folder that holds a layer's versions, and of the manifest that names the one that counts."""
    base = f"{folder.rstrip('/')}/{layer}.versions"
    return base, f"{folder.rstrip('/')}/{layer}.parquet.provenance.json"


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def write_provenance(spark: SparkSession, path: str, source: str, parameters: dict, table: str | None = None) -> None:
    """The manifest: written beside its place, then put there in one step that replaces the one before."""
    held = {"source": source, "parameters": parameters, "date": datetime.now(UTC).isoformat(timespec="seconds"), "table": table}
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs, p = _fs(spark, path)
    new = hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(held, sort_keys=True).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.makeQualified(p).toUri(), spark._jsparkSession.sessionState().newHadoopConf()).rename(fs.makeQualified(new), fs.makeQualified(p), options)


def read_provenance(spark: SparkSession, path: str) -> dict | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    rows = spark.read.text(path, wholetext=True).collect()
    try:
        return json.loads(rows[0][0])
    except (ValueError, IndexError):
        return None


def differences(known: dict | None, source: str, parameters: dict) -> list[str]:
    """Names of parameters that changed or are on one side only; ``sidecar_absent`` without provenance."""
    if known is None:
        return ["sidecar_absent"]
    old = known.get("parameters", {})
    out = sorted(k for k in {*old, *parameters} if k not in old or k not in parameters or old[k] != parameters[k])
    return out + (["source"] if known.get("source") != source else [])


def cached(spark: SparkSession, folder: str, layer: str, source: str, parameters: dict, acquire: Callable[[], DataFrame | None], policy: str = "reacquerir") -> DataFrame | None:
    """The layer from the cache if its parameters agree, else as the policy says. An empty answer is not kept.

    A new version is written whole into a folder of its own before the manifest names it: whoever dies in between leaves the old layer with
    its own parameters. The version before stays for those who still read it; older ones go.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    base, side = paths(folder, layer)
    known = read_provenance(spark, side)
    table = (known or {}).get("table")
    if table:
        gaps = differences(known, source, parameters)
        if not gaps or policy == "ignorer":
            return spark.read.parquet(table)
        if policy == "echouer":
            raise ValueError(f"cached {layer} differs in {gaps}")
        if policy == "avertir":
            log.warning("cached %s differs in %s", layer, gaps)
            return spark.read.parquet(table)
    got = acquire()
    if got is None:
        return None
    new = f"{base}/{uuid.uuid4().hex}"
    got.write.parquet(new)
    write_provenance(spark, side, source, parameters, new)
    fs, p = _fs(spark, base)
    kept = {v.rsplit("/", 1)[1] for v in (new, table) if v}
    for status in fs.listStatus(p):
        if status.getPath().getName() not in kept:
            fs.delete(status.getPath(), True)
    return spark.read.parquet(new)
