"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint has two segments of 32 bits. Two fingerprints that
differ in at most three bits differ in at most one bit of one segment, so
each fingerprint asks the table of each segment for the 33 keys of its ball
of radius one; matches are verified over all 64 bits.

A segment key that more than ``max_bucket`` distinct fingerprints share is
not expanded into pairs. Its fingerprints are linked through balls of points
instead: fingerprints within three bits have a point within one bit of the
one and two bits of the other, and all fingerprints around such a point can
be tied to a single one of them. Both ways are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.tables import slices
from timberline.plans.components import connected_components
from timberline.session import materialize, release

SHINGLE = 3
SEED = 42
MAX_BITS = 3
MAX_BUCKET = 128


def fingerprint(text: str | None, shingle: int = SHINGLE) -> bytes:
    """Eight bytes; zero bytes for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return b"\0" * 8
    joined, size = b" ".join(words), min(shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[size - 1 :].tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[: len(ends)].tolist(), ends)])
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` holds the 64 bits as a long. Null text counts as empty."""

    def run(batches):
        for batch in batches:
            for piece, texts in slices(batch, 1):
                raw = b"".join([fingerprint(t, shingle) for t in texts])
                fp = np.frombuffer(raw, ">i8").astype(np.int64)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(fp)], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _ball(value: Column) -> Column:
    """A 32-bit value and the values one bit away."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") for k in range(32)])
    return F.transform(flips, lambda b: value.bitwiseXOR(b))


def _half(fp: Column, segment: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if segment == 0 else fp.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def links(fps: DataFrame, max_bits: int = MAX_BITS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Edges ``(src, dst)`` between representatives of distinct fingerprints ``(fp, rep)``.

    Every edge joins fingerprints of at most three differing bits, and the
    edges connect all such fingerprints, directly or through others.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with balls of radius one reach three bits")
    tag = F.lit(1 << 33).cast("long")
    own = F.array(_half(F.col("fp"), 0), _half(F.col("fp"), 1).bitwiseOR(tag))
    entries = fps.select("fp", "rep", F.explode(own).alias("key"))
    asked = F.concat(_ball(_half(F.col("fp"), 0)), F.transform(_ball(_half(F.col("fp"), 1)), lambda k: k.bitwiseOR(tag)))
    probes = fps.select("fp", "rep", F.explode(asked).alias("key"))
    crowded = materialize(entries.groupBy("key").count().filter(F.col("count") > max_bucket).select("key"))
    some = not crowded.isEmpty()
    table = entries.join(crowded, "key", "left_anti") if some else entries
    a, b = probes.alias("a"), table.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") != F.col("b.rep")) & near)
    edges = pairs.select(F.greatest("a.rep", "b.rep").alias("src"), F.least("a.rep", "b.rep").alias("dst"))
    if not some:
        return edges.distinct()
    dense = materialize(probes.join(crowded, "key", "left_semi").select("fp", "rep").distinct())
    return edges.union(_through_points(dense, max_bits)).distinct()


def _through_points(dense: DataFrame, max_bits: int) -> DataFrame:
    """Edges among fingerprints of crowded keys, in rows that grow with their number only."""
    one = [1 << k for k in range(64)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    near = F.array(*[F.lit(signed(x)).cast("long") for x in [0, *one]])
    two = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(62)),
            lambda i: F.transform(
                F.sequence(i + 1, F.lit(63)), lambda j: _bit(i).bitwiseXOR(_bit(j))
            ),
        )
    )
    # radii that add up to max_bits
    inner, outer = {0: (0, 0), 1: (0, 1), 2: (1, 1), 3: (1, 2)}[max_bits]
    reach = {0: F.array(F.lit(0).cast("long")), 1: near, 2: F.concat(near, two)}
    points = lambda r: F.explode(F.transform(reach[r], lambda m: F.col("fp").bitwiseXOR(m)))
    hubs = materialize(dense.select("rep", points(inner).alias("p")).groupBy("p").agg(F.min("rep").alias("hub")))
    around = dense.select("rep", points(outer).alias("p"))
    return around.join(hubs, "p").filter("rep <> hub").select(F.greatest("rep", "hub").alias("src"), F.least("rep", "hub").alias("dst")).distinct()


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS,
                    max_bucket: int = MAX_BUCKET, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Documents whose fingerprints differ in ``max_bits`` bits at most are
    linked; ``component_id`` is the smallest id reachable. Exact copies share
    a fingerprint and are handled as one. Null or empty text has fingerprint
    zero and is linked like any other. Rows with a null id link others and get the component
    of their fingerprint, null if all rows of that component have none.
    Repeated rows are returned as often as they come; an empty table gives
    an empty result. Other columns are not carried.
    """
    fpd = materialize(fingerprints(docs, id_col, text_col, shingle))
    fps = materialize(fpd.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = materialize(links(fps.select("fp", F.col("fp").alias("rep")), max_bits, max_bucket))
    parts = materialize(connected_components(edges))
    placed = materialize(fps.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("part")))
    ids = placed.groupBy("part").agg(F.min("least").alias("component_id"))
    whole = materialize(placed.join(ids, "part").select("fp", "component_id"))
    for done in (fps, edges, parts, placed):
        release(done)
    out = materialize(fpd.join(whole, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
    for done in (fpd, whole):
        release(done)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate group; columns stay as they are.

    Rows with a null id stay, as nothing can name them. Of several rows with
    one id all stay: they are one document.
    """
    groups = near_duplicates(docs, id_col, text_col, **options)
    gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("__tl_gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("__tl_gone"), "left_anti")
