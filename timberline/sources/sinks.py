"""Outputs: layers, map styles, report."""

from __future__ import annotations

import os
import sqlite3
import struct
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame

PALETTE = ("#1a9641", "#d7191c", "#fdae61", "#2c7bb6", "#7b3294", "#636363")


def write_layers(layers: dict[str, DataFrame], folder: str, overwrite: bool = True) -> list[str]:
    """One Parquet table for each layer; names are required."""
    if not layers or any(not k or not isinstance(v, DataFrame) for k, v in layers.items()):
        raise ValueError("layers: a named DataFrame each")
    out = []
    for name, df in layers.items():
        path = f"{folder.rstrip('/')}/{name}"
        df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
        out.append(path)
    return out


def wkb_line(points: list[tuple[float, float]]) -> bytes:
    return struct.pack("<BII", 1, 2, len(points)) + b"".join(struct.pack("<dd", *p) for p in points)


def write_geopackage(layers: dict[str, DataFrame], path: str, srid: int = 2154) -> None:
    """A GeoPackage for handing over: rows stream through the driver one by one, so this is for results, not for tables.

    Lines are in ``x1, y1, x2, y2`` or in ``geom`` (array of x, y).
    """
    if os.path.exists(path):
        os.remove(path)
    db = sqlite3.connect(path)
    db.executescript("""
PRAGMA application_id = 1196444487;
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z TINYINT, m TINYINT, PRIMARY KEY (table_name, column_name));
""")
    db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{srid}", srid, srid))
    for name, df in layers.items():
        plain = [c for c in df.columns if c not in ("x1", "y1", "x2", "y2", "geom")]
        fields = "".join(f', "{c}"' for c in plain)
        db.execute(f'CREATE TABLE "{name}" (fid INTEGER PRIMARY KEY, geom BLOB{fields})')
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (name, name, srid))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'LINESTRING', ?, 0, 0)", (name, srid))
        head = b"GP\0\x01" + struct.pack("<i", srid)
        marks = ", ".join("?" * (len(plain) + 1))
        for row in df.toLocalIterator():
            pts = [(p["x"], p["y"]) for p in row["geom"]] if "geom" in df.columns else [(row["x1"], row["y1"]), (row["x2"], row["y2"])]
            values = [v if isinstance(v, (int, float, str, bytes, type(None))) else str(v) for v in (row[c] for c in plain)]
            db.execute(f'INSERT INTO "{name}" (geom{fields}) VALUES ({marks})', [head + wkb_line(pts), *values])
    db.commit()
    db.close()


def categorised_style(field: str, values: list[str], colours: dict[str, str] | None = None) -> str:
    """Style document with one line symbol for each value."""
    pick = colours or {}
    cats, symbols = [], []
    for k, v in enumerate(values):
        colour = pick.get(v, PALETTE[k % len(PALETTE)])
        rgb = ",".join(str(int(colour[i : i + 2], 16)) for i in (1, 3, 5)) + ",255"
        cats.append(f'      <category value={quoteattr(v)} label={quoteattr(v)} symbol="{k}" render="true"/>')
        symbols.append(f'      <symbol name="{k}" type="line"><layer class="SimpleLine"><Option type="Map"><Option name="line_color" value="{rgb}" type="QString"/><Option name="line_width" value="0.6" type="QString"/></Option></layer></symbol>')
    return "\n".join(["<!DOCTYPE qgis PUBLIC 'http://mrcc.com/qgis.dtd' 'SYSTEM'>", '<qgis version="3.28">', f'  <renderer-v2 type="categorizedSymbol" attr={quoteattr(field)}>',
                      "    <categories>", *cats, "    </categories>", "    <symbols>", *symbols, "    </symbols>", "  </renderer-v2>", "</qgis>"])


def report(sections: dict[str, DataFrame], title: str = "Desserte", rows: int = 100) -> str:
    """Markdown of summary tables, ``rows`` of each at most."""
    out = [f"# {title}"]
    for name, df in sections.items():
        got = df.limit(rows).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        for row in got:
            out.append("| " + " | ".join("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in row) + " |")
    return "\n".join(out) + "\n"
