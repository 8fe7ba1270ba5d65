"""Whitening of vectors by hierarchical merging of singular value decompositions.

A part of the vectors is summed up by its number, its exact sums and the singular
values and right vectors of its rows minus their mean, all of them: as many as there are
dimensions. Two parts are merged by laying their values times vectors on top of each
other, adding one row for the distance of their means, and decomposing again. That is
the decomposition of both parts' rows together; nothing is cut off at any level.

Tasks sum up their rows batch by batch. Their summaries are merged in groups of ``FAN_IN``,
level by level, on the executors; one summary, of a size that the number of dimensions sets,
comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.session import materialize, release

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Summaries that one group merges.
FAN_IN = 16
#: Rows that are decomposed at once.
ROWS = 4_096
#: Share of the largest eigenvalue below which a direction counts as one without variance: what rounding leaves.
FLAT = 1e-13
LONG = (1 << 63) - 1


@dataclass
class Summary:
    """Number of rows, exact sums, singular values and right singular vectors (as rows) of the centred rows."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        """Of rows of integers; whole numbers are taken off before the rows are centred, so that little is rounded."""
        sums = [int(s) for s in _sums(x)]
        return cls(len(x), sums, *_svd(_centred(x, len(x), sums)))

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        apart = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums)])
        bridge = math.sqrt(self.n / n * other.n) * apart
        stack = np.vstack([self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, bridge[None, :]])
        return Summary(n, [a + b for a, b in zip(self.sums, other.sums)], *_svd(stack))

    def row(self) -> dict:
        return {"n": self.n, "sums": [str(s) for s in self.sums], "values": self.values.tobytes(), "vectors": self.vectors.tobytes()}

    @classmethod
    def read(cls, row: dict) -> Summary:
        values = np.frombuffer(row["values"])
        return cls(row["n"], [int(s) for s in row["sums"]], values, np.frombuffer(row["vectors"]).reshape(len(values), -1))


SCHEMA = "part long, n long, sums array<string>, values binary, vectors binary"
_ARROW = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("values", pa.binary()), ("vectors", pa.binary())])


def _sums(x: np.ndarray) -> list[int]:
    """Exact sums of columns: of upper and lower halves, which don't overflow for less than 2^31 rows."""
    upper, lower = x >> 32, x & 0xFFFFFFFF
    return [(int(u) << 32) + int(w) for u, w in zip(upper.sum(axis=0), lower.sum(axis=0))]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - sums / n`` in doubles; the whole part of the mean goes first, in integers."""
    whole = [s // n for s in sums]
    rest = np.array([(s - w * n) / n for s, w in zip(sums, whole)])
    return (x - np.array(whole, np.int64)).astype(float) - rest


def _svd(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and vectors, filled up to all dimensions by directions of value 0 where there are fewer rows."""
    d = rows.shape[1]
    if len(rows) < d:
        rows = np.vstack([rows, np.zeros((d - len(rows), d))])
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s, vt


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``(vec_id, x)``: components as floor(scale * c) + shift. Null vectors and those with a null or non-finite component go, also those of another
    length than most of the rest, the smaller length of two that are equally frequent, and empty ones."""
    c = F.col("c")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c"))
    fine = rows.filter(c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    usual = fine.groupBy(F.size(c).alias("d")).count().orderBy(F.desc("count"), "d").first()
    far = float(1 << 61)  # beyond that no long holds the sums
    limited = F.transform(c, lambda v: F.floor(F.greatest(F.lit(-far), F.least(F.lit(far), v * scale))) + shift)
    return fine.filter(F.size(c) == (usual["d"] if usual else 0)).select("vec_id", limited.alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], at: int, rows: int = ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for k in range(0, len(batch), rows):
            piece = batch.slice(k, rows)
            if len(piece):
                yield piece, piece.column(at).flatten().to_numpy(zero_copy_only=False).reshape(len(piece), -1)


def summary(rows: DataFrame, fan_in: int = FAN_IN) -> Summary | None:
    """Of all ``x`` in ``rows``; None where there are none."""

    def first(batches):
        from pyspark import TaskContext

        held = None
        for _, x in _matrices(batches, 0):
            one = Summary.of(x)
            held = held.merged(one) if held else one
        if held:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), **held.row()}], schema=_ARROW)

    def merge(key, table):
        held = None
        for row in sorted(table.to_pylist(), key=lambda r: r["part"]):
            held = held.merged(Summary.read(row)) if held else Summary.read(row)
        return pa.Table.from_pylist([{"part": key[0].as_py(), **held.row()}], schema=_ARROW)

    parts = materialize(rows.select("x").mapInArrow(first, SCHEMA))
    while True:
        count = parts.count()
        if count <= 1:
            break
        # parts are numbered through, so that each level has the fan-in it should
        level = parts.withColumn("part", F.floor(F.col("part") / fan_in)).groupBy("part").applyInArrow(merge, SCHEMA)
        merged = materialize(level)
        release(parts)
        parts = merged
    found = parts.first()
    release(parts)
    return Summary.read(found.asDict()) if found else None


@dataclass
class Whitening:
    """Mean and all directions with variance, strongest first."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    @classmethod
    def of(cls, found: Summary) -> Whitening:
        e = found.values**2 / found.n
        kept = e > FLAT * e.max(initial=0)
        return cls(found.n, found.sums, e[kept], found.vectors[kept], float(e.sum()))

    def apply(self, x: np.ndarray, count: int) -> np.ndarray:
        return _centred(x, self.n, self.sums) @ (self.components[:count] / np.sqrt(self.eigenvalues[:count, None])).T

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sums)^2, exact; None where a long cannot hold it."""
        rough = ((_centred(x, self.n, self.sums) * self.n) ** 2).sum(axis=1)
        if rough.max(initial=0) < 2.0**62:
            return ((x * self.n - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = (sum((int(v) * self.n - s) ** 2 for v, s in zip(row, self.sums)) for row in x)
        return [v if v <= LONG else None for v in exact]


def fit(distinct: DataFrame) -> Whitening | None:
    """From a table with integer vectors ``x``, each counted once a row; None where it has no rows."""
    found = summary(distinct)
    return Whitening.of(found) if found else None


def identity_error(rows: DataFrame, model: Whitening, count: int) -> float:
    """Largest absolute entry of the covariance of whitened rows minus the identity, measured over the rows."""
    count = min(count, len(model.eigenvalues))

    def moments(batches):
        both, one = np.zeros((count, count)), np.zeros(count)
        for _, x in _matrices(batches, 0):
            w = model.apply(x, count)
            both += w.T @ w
            one += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(count * (count + 1))), pa.array(np.concatenate([both.ravel(), one]))], names=["at", "v"])

    sums = {r["at"]: r["v"] for r in rows.select("x").mapInArrow(moments, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}
    mean = np.array([sums[count * count + i] for i in range(count)]) / model.n
    cov = np.array([sums[i] for i in range(count * count)]).reshape(count, count) / model.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(count)).max(initial=0))


def whiten(vectors: DataFrame, count: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for each usable row and component up to ``count``.

    The model is fitted on each distinct integer vector once; every usable row is
    projected, repeated rows and rows with a null id as often as they come. Components run from 1 by falling
    variance; directions without variance are none, so that a table whose vectors are all equal gives
    no rows, like an empty one. ``deviation`` is null where a long cannot hold it. Components of more than 2^61 in
    size, times the scale, count as 2^61. Which vectors are usable, ``quantized`` says. Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = quantized(vectors, id_col, vector_col).withColumn("vec_id", F.col("vec_id").cast("long"))
    distinct = materialize(rows.select("x").distinct())
    model = fit(distinct)
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], schema)
    error = identity_error(distinct, model, count)
    release(distinct)
    used = min(count, len(model.eigenvalues))
    explained = model.eigenvalues[:used] / model.trace

    def run(batches):
        for piece, x in _matrices(batches, 1):
            w = model.apply(x, used)
            repeat = lambda a: a.take(pa.array(np.repeat(np.arange(len(x)), used)))
            yield pa.RecordBatch.from_arrays(
                [repeat(piece.column(0)), pa.array(np.tile(np.arange(1, used + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * used, model.n)),
                 repeat(pa.array(model.deviations(x), pa.int64())), pa.array(w.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * used, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
