"""Every core query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from timberline import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    return con


def plain(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA:
            return "null"
        return f"{float(v):.6g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iufb" else str(v)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, db, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), db.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_clearances_are_rounded_as_sql_does(spark, db, monkeypatch):
    """Values halfway between two decimals, as Spark and DuckDB round them to different ones."""
    half, columns = [2784.37805, 9.26865, 2099.43335, 11.27855, 0.15625, float("inf")], ("LARGEUR_DEGAGEE", "DEGAGE_G", "DEGAGE_D", "SURPLOMB", "HAUT_SURPLOMB")
    rows = spark.createDataFrame([(k, *[v] * 5) for k, v in enumerate([*half, None])], "trace_id int, " + ", ".join(f"{c} double" for c in columns))
    monkeypatch.setattr(queries.measure, "lateral_clearance", lambda *a, **k: rows)
    want = [v for (v,) in db.sql(f"SELECT round(v, 4) FROM (SELECT unnest({[str(v) for v in half]})::DOUBLE AS v)").fetchall()] + [None]
    got = queries.QUERIES["lateral_clearance"](spark, SF).orderBy("trace_id").collect()
    assert [[r[c] for r in got] for c in columns] == [want] * 5


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
