"""Exact top-k inner products with a pivot-distance index.

One more component makes all vectors equally long, so that the largest inner
product is the least distance. Each vector is keyed by its nearest pivot and
its distance to it. The vectors of a pivot are cut into annuli by distance; a query goes
to those that the triangle inequality leaves open. There it meets the vectors in
rings of sorted distance, nearest ring first, and stops where no ring is left that
could hold a score as good as its k-th. Pivots, and the rows that
give a first bound on each query's k-th score, are bounded samples; they
steer the search and never its result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.session import materialize, release

PIVOTS = 64
BOUND_SAMPLE = 2_048
#: Vectors and queries that meet in one group, about.
BLOCK = 16_384
QUERY_BLOCK = 8_192
RING = 512
#: Annuli of a pivot at most; larger ones are dealt by a hash of the id.
ANNULI = 1_024
SCALE = 256


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)``: components as floor(scale * x). Null ids, null vectors and those with a null or non-finite component go."""
    x = F.col("x")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & x.isNotNull() & fine).select(
        "vec_id", F.transform(x, lambda c: F.floor(c * scale)).alias("v")
    )


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of a list column as int64, padded with zeros to ``dim``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), dim), np.int64)
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products; by floating-point matrices where they cannot round."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    return np.rint(q.astype(float) @ v.T.astype(float)).astype(np.int64) if top < 2.0**52 else q @ v.T


class Pivots:
    """Pivots in the space with one more component, in which all vectors have length ``reach``."""

    def __init__(self, rows: np.ndarray, reach2: float):
        self.reach2 = reach2
        self.at = self.lift(rows)

    def lift(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(float)
        return np.concatenate([v, np.sqrt(np.maximum(self.reach2 - (v * v).sum(axis=1), 0))[:, None]], axis=1)

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        d2 = (lifted * lifted).sum(axis=1)[:, None] + (self.at * self.at).sum(axis=1) - 2 * lifted @ self.at.T
        return np.sqrt(np.maximum(d2, 0))


def _best(rows, ids, scores, k):
    """Of (row, id, score) triples the k best of each row, ties to the smaller id."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    first = np.searchsorted(rows, rows, "left")
    keep = np.arange(len(rows)) - first < k
    return rows[keep], ids[keep], scores[keep]


def search_block(v: np.ndarray, ids: np.ndarray, dist: np.ndarray, q: np.ndarray, qids: np.ndarray, to_pivot: np.ndarray,
                 floor: np.ndarray, reach2: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of a block for each query that could be among the k best of all.

    ``floor`` holds a score that at least k vectors are known to reach.
    """
    order = np.argsort(dist, kind="stable")
    v, ids, dist = v[order], ids[order], dist[order]
    cuts = np.arange(0, len(v), RING)
    low, high = dist[cuts], dist[np.minimum(cuts + RING, len(v)) - 1]
    gap = np.maximum(0, np.maximum(low - to_pivot[:, None], to_pivot[:, None] - high))
    length2 = (q.astype(float) ** 2).sum(axis=1)
    slack = 1e-7 * (length2 + reach2) + 1.0  # distances are rounded
    most = (length2[:, None] + reach2 - gap * gap) / 2 + slack[:, None]
    nearest = np.argsort(gap, axis=1, kind="stable")
    kth = floor.astype(float).copy()
    held = (np.zeros(0, np.int64),) * 3
    for step in range(len(cuts)):
        ring = nearest[:, step]
        going = np.flatnonzero(most[np.arange(len(q)), ring] >= kth)
        if not len(going):
            break
        new = []
        for r in np.unique(ring[going]):
            who = going[ring[going] == r]
            part = slice(cuts[r], cuts[r] + RING)
            s = _products(q[who], v[part])
            a, b = np.nonzero((s >= kth[who][:, None]) & (ids[part] != qids[who][:, None]))
            new.append((who[a], ids[part][b], s[a, b]))
        held = _best(*(np.concatenate(x) for x in zip(held, *new)), k)
        rows, counts = np.unique(held[0], return_counts=True)
        ends = np.cumsum(counts) - 1
        full = counts >= k
        kth[rows[full]] = np.maximum(kth[rows[full]], held[2][ends[full]])
    return held


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding",
          pivots: int = PIVOTS, sample: int = BOUND_SAMPLE, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each id divisible by ``every`` its k best among all other rows.

    Exact: scores are integer inner products, ties go to the smaller id, and
    every vector is in the index. Fewer candidates than k give fewer rows.
    Rows without an id or a whole finite vector take no part; vectors of
    differing length count as padded with zeros. An id that comes more than
    once asks once, with its least vector, and its rows are no candidates
    of its own. A group of the search holds about ``block`` vectors of one annulus and
    ``QUERY_BLOCK`` queries: vectors are sent once for so many queries that reach their annulus.
    """
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score long"
    base = materialize(quantized(vectors, id_col, vector_col))
    norm2 = F.aggregate("v", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double"))
    facts = base.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(norm2).alias("reach2")).first()
    if not facts["n"]:
        return spark.createDataFrame([], empty)
    dim, reach2 = int(facts["dim"]), float(facts["reach2"])
    some = base.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(max(pivots, sample)).toArrow()
    known, known_ids = _matrix(some.column("v"), dim), some.column("vec_id").to_numpy()
    grid = Pivots(np.unique(known[:pivots], axis=0), reach2)
    shared = spark.sparkContext.broadcast((grid, known[:sample], known_ids[:sample]))

    def key(batches):
        for b in batches:
            if b.num_rows:
                d = shared.value[0].distances(shared.value[0].lift(_matrix(b.column(1), dim)))
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["vec_id", "v", "cell", "dist"]
                )

    index = materialize(base.mapInArrow(key, "vec_id long, v array<bigint>, cell int, dist double"))
    # bounds of the annuli: so many a pivot that each holds a block, and ANNULI at most
    sizes = index.groupBy("cell").agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n")).first()[0]
    cuts = min(ANNULI, -(-largest // block))
    bounds: dict[int, np.ndarray] = {}
    if cuts > 1:
        share = [i / cuts for i in range(1, cuts)]
        for r in index.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("dist", share).alias("at")).collect():
            own = min(cuts, -(-r["n"] // block))
            bounds[r["cell"]] = np.unique([r["at"][round(i * cuts / own) - 1] for i in range(1, own)])
    shared_bounds = spark.sparkContext.broadcast(bounds)

    def ring(batches):
        for b in batches:
            cell, dist = b.column(2).to_numpy(), b.column(3).to_numpy()
            out = np.zeros(len(cell), np.int32)
            for c in np.unique(cell).tolist():
                who = cell == c
                out[who] = np.searchsorted(shared_bounds.value.get(c, ()), dist[who], "left")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=["vec_id", "v", "cell", "dist", "ring"])

    ringed = index.mapInArrow(ring, "vec_id long, v array<bigint>, cell int, dist double, ring int")
    # at most ANNULI rows a pivot come to the driver
    facts = {(r["cell"], r["ring"]): (r["n"], r["low"], r["high"]) for r in ringed.groupBy("cell", "ring").agg(
        F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).collect()}
    asked = base.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    annuli = {c: sorted(x for x in facts if x[0] == c) for c in {x[0] for x in facts}}
    shared_annuli = spark.sparkContext.broadcast({c: (np.array([r for _, r in x], np.int32), np.array([facts[k][1] for k in x]), np.array([facts[k][2] for k in x])) for c, x in annuli.items()})

    def route(batches):
        grid, near, near_ids = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            q, qid = _matrix(b.column(1), dim), b.column(0).to_numpy()
            scores = _products(q, near).astype(float)
            scores[near_ids == qid[:, None]] = -np.inf
            floor = np.full(len(q), -(2.0**62))
            if scores.shape[1] > k:
                floor = np.maximum(floor, np.sort(scores, axis=1)[:, -k])
            d = grid.distances(np.concatenate([q.astype(float), np.zeros((len(q), 1))], axis=1))
            length2 = (q.astype(float) ** 2).sum(axis=1)
            radius = np.sqrt(np.maximum(length2 + reach2 - 2 * floor + 2e-7 * (length2 + reach2) + 2, 0))
            for c, (rings, low, high) in shared_annuli.value.items():
                who, at = np.nonzero(((d[:, c] - radius)[:, None] <= high) & ((d[:, c] + radius)[:, None] >= low))
                if len(who):
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(who)), b.column(1).take(pa.array(who)), pa.array(np.full(len(who), c, np.int32)),
                         pa.array(rings[at]), pa.array(d[who, c]), pa.array(floor[who].astype(np.int64))],
                        names=["vec_id", "v", "cell", "ring", "to_pivot", "floor"],
                    )

    routed = held = materialize(asked.mapInArrow(route, "vec_id long, v array<bigint>, cell int, ring int, to_pivot double, floor long"))
    reached = {(r["cell"], r["ring"]): r["count"] for r in routed.groupBy("cell", "ring").count().collect()}
    plan = [(c, r, -(-facts[c, r][0] // block), -(-n // QUERY_BLOCK)) for (c, r), n in reached.items()]
    deal = lambda: F.broadcast(spark.createDataFrame(plan, "cell int, ring int, parts int, turns int"))
    among = lambda seed, n: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = ringed.join(deal(), ["cell", "ring"]).withColumn("part", among(9, "parts")).withColumn("turn", each("turns"))
    routed = routed.join(deal(), ["cell", "ring"]).withColumn("turn", among(5, "turns")).withColumn("part", each("parts"))
    keys = ["cell", "ring", "part", "turn"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        qids = right.column("vec_id").to_numpy()
        rows, ids, scores = search_block(
            _matrix(left.column("v"), dim), left.column("vec_id").to_numpy(), left.column("dist").to_numpy(), _matrix(right.column("v"), dim),
            qids, right.column("to_pivot").to_numpy(), right.column("floor").to_numpy(), reach2, k,
        )
        return pa.table({"query_id": pa.array(qids[rows]), "vec_id": pa.array(ids), "score": pa.array(scores)})

    found = dealt.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    best = materialize(found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    for done in (base, index, held):
        release(done)
    return best
