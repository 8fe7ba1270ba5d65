"""Connected components as rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.session import materialize, release


def _signature(links: DataFrame) -> tuple:
    """Number of links and a checksum over them in any order: equal only for equal tables, but for a chance of 2^-64."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node: ``(node, component)``.

    Alternates the large-star and small-star rewirings, which take a number
    of rounds that grows with the logarithm of the node count. Node minima
    are partial aggregates written between the steps, so that both sides of
    each join are plain exchanges and AQE may split the partition of a hub.

    Self loops give a component of one node. Rows with a null end are
    ignored. Node columns may be of any orderable type. An empty table gives
    an empty result.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    loops = pairs.filter("u = v").select(F.col("u").alias("node"))
    links = materialize(
        pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    start, mark = links, _signature(links)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        # large star: neighbours above u are linked to the least of u and its neighbours
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = materialize(
            both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        )
        # small star: u and its neighbours below are linked to the least of those
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(least, "u")
        small = materialize(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        before, mark = mark, _signature(small)
        for gone in (low, large, least) + ((links,) if links is not start else ()):
            release(gone)
        links = small
        if mark == before:
            break
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    alone = loops.distinct().join(stars, "node", "left_anti").join(roots, "node", "left_anti")
    return stars.union(roots).union(alone.select("node", F.col("node").alias("component")))
