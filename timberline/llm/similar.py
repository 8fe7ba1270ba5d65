"""Near-duplicates of a similarity: wide SimHash fingerprints, multi-index hashing, exact verification.

The similarity of two documents is the share of their distinct word shingles
that both have. A bit of a SimHash fingerprint differs with the chance
arccos(cosine) / pi, at similarity 0.8 with 0.15. A fingerprint is cut into
segments; each document enters, for every segment, the points of the lower ball
of radius one around its value (the value, and it with one bit cleared).
Two documents that share a point differ in at most two bits of that segment.
How many segments and how long: ``plan`` gives as many as find a pair at
the bound with the chance ``RECALL``, closer pairs with more, and as long as keep
chance meetings few for the number of documents.

What meets is held against a distance over all bits that pairs at the bound stay
under but for a few in a hundred thousand, and then compared over its whole
shingle sets: no pair below the bound is linked.

Documents with equal sets are one. Points that more than ``max_bucket`` sets share
are not expanded into pairs. The sets at such points, and those that meet others very often at smaller ones, are compared with each other by an exact way instead, which finds all
their pairs at the bound: two such sets share one of their rarest members, counted over all crowded
sets, and few sets share a rare one (``_rare``). So a crowd of texts over one template, alike to 0.5, falls apart into
its close pairs. Where many share even a rare member they are mostly edited copies of one text: all are compared
with the set at their centre, their hub. What that leaves unlinked is sought among the differences from the hub: who is not like the hub
is like another only if both differ from it in the same members, in some half of the other's differences at
least (``_from_hubs``). They meet at rare ones of these, again.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.tables import slices
from timberline.plans.components import connected_components
from timberline.session import materialize, release

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.98
SEED = 42
MAX_BUCKET = 16
#: Sets that share a rare member and are all compared with each other, at most.
CROWD = 48
#: Times that what is crowded is seen from hubs; what is crowded after them is expanded into pairs.
ROUNDS = 4
#: Meetings of a set at its points, from which on it counts as crowded though none of its points is.
MEETINGS = 256
#: One set in so many shows which points are very crowded.
SHOWN = 64
#: Rows of a table that is sent to all tasks, at most: 16 MB of ids.
SENT = 2_000_000
#: Pairs for which a set is sent once.
BLOCK = 1_024
#: Standard deviations over the mean distance of pairs at the bound that are still compared.
SLACK = 4.3
#: Bits kept beside each point, to leave out most chance meetings on the spot.
CHECK = 64


def differing(similarity: float) -> float:
    """Chance that one bit differs, for sets of equal size."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def meeting(bits: int, similarity: float) -> float:
    """Chance that the lower balls of one segment meet."""
    q = differing(similarity)
    same = 1 - q
    return same**bits + bits * q * same ** (bits - 1) + bits * (bits - 1) / 4 * q * q * same ** (bits - 2)


def plan(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a segment and number of segments for ``n`` documents."""
    bits = min(40, max(16, math.ceil(math.log2(max(n, 2))) + 6))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meeting(bits, similarity)))


def most(bits: int, similarity: float) -> int:
    """Differing bits of ``bits`` that are still compared."""
    q = differing(similarity)
    return min(bits, math.ceil(bits * q + SLACK * math.sqrt(bits * q * (1 - q))))


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, a text without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, size = b" ".join(words), min(shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(ends)].tolist(), ends)], np.uint64))


def name(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set, as two signed numbers."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes(), SEED), np.int64).tolist())


def fingerprint(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """64 bits a lane: set where over half the shingles' mixed hashes have the bit set."""
    seeds = np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    total = np.zeros(64 * lanes, np.int64)
    for k in range(0, len(hashes), 255):
        h = hashes[k : k + 255, None] + seeds
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        total += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return (total * 2 > len(hashes)).view(np.uint8)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the distinct members of two sorted sets that both have; empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - both
    return both / total if total else 1.0


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, bits: int, segments: int) -> DataFrame:
    """``(doc_id, sig, more, lane, segments)``: the name of the set in two halves, the bits kept beside each point, the values of the segments."""
    lanes = CHECK // 64 + -(-bits * segments // 64)
    powers = np.int64(1) << np.arange(bits, dtype=np.int64)

    def run(batches):
        for batch in batches:
            for piece, texts in slices(batch, 1):
                sets = [shingle_set(t, shingle) for t in texts]
                raw = np.stack([fingerprint(s, lanes) for s in sets])
                lane = np.packbits(raw[:, :CHECK], axis=1).view(">i8").astype(np.int64).ravel()
                values = raw[:, CHECK : CHECK + bits * segments].reshape(-1, segments, bits) @ powers
                names = np.array([name(s) for s in sets], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(lane),
                     pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * segments, pa.array(values.ravel()))],
                    names=["doc_id", "sig", "more", "lane", "segments"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, sig long, more long, lane long, segments array<long>")


def _sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(doc_id, sig, more, hashes)`` of whole sets."""

    def run(batches):
        for batch in batches:
            for piece, texts in slices(batch, 1):
                sets = [shingle_set(t, shingle) for t in texts]
                names = np.array([name(s) for s in sets], np.int64).reshape(-1, 2)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = pa.array(np.concatenate([np.empty(0, np.int64), *(s.view(np.int64) for s in sets)]))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "sig", "more", "hashes"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, sig long, more long, hashes array<long>")


def _points(bits: int) -> Column:
    """Points of the lower balls of all segments, with the segment in the upper bits."""
    zero = F.lit(0).cast("long")
    flips = F.array(zero, *[F.lit(1 << k).cast("long") for k in range(bits)])
    lower = lambda v, i: F.transform(
        F.filter(flips, lambda b: b.bitwiseAND(v) == b), lambda b: v.bitwiseXOR(b) + i.cast("long") * F.lit(1 << bits).cast("long")
    )
    return F.flatten(F.transform("segments", lower))


def _small(df: DataFrame) -> DataFrame:
    """Marked for sending to all tasks if it is a written table of ``SENT`` rows at most; a plain side of a join beyond."""
    return F.broadcast(df) if df.count() <= SENT else df


def _compared(pairs: DataFrame, sets: DataFrame, bound: float) -> DataFrame:
    """Of distinct pairs ``(a, b)`` of representatives those with sets of similarity ``bound`` at least, written out.

    Pairs are dealt by ``a`` and, where many have one ``a``, by a hash of ``b``: a task gets the set of ``a`` once
    for each such block, in front of the sets it is compared with.
    """

    def run(batches):
        at, held = None, []
        for batch in batches:
            a, blk, b = (batch.column(i).to_pylist() for i in range(3))
            offsets, flat = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy()
            out_a, out_b = [], []
            for k in range(len(a)):
                mine = flat[offsets[k] : offsets[k + 1]]
                if (a[k], blk[k]) != at:
                    at, held = (a[k], blk[k]), []
                if b[k] is None:
                    held.append(mine.copy())  # several where an id has several texts
                elif any(similarity(x, mine) >= bound for x in held):
                    out_a.append(a[k])
                    out_b.append(b[k])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    often = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = pairs.join(often, "a").select("a", F.pmod(F.xxhash64("b"), F.lit(1) + F.floor(F.col("n") / BLOCK)).alias("blk"), "b")
    of = sets.select(F.col("rep"), "hashes")
    right = dealt.join(of.withColumnRenamed("rep", "b"), "b").select("a", "blk", "b", "hashes")
    left = dealt.select("a", "blk").distinct().join(of.withColumnRenamed("rep", "a"), "a").select("a", "blk", F.lit(None).cast("long").alias("b"), "hashes")
    ordered = left.unionByName(right).repartition("a", "blk").sortWithinPartitions("a", "blk", F.col("b").asc_nulls_first())
    return materialize(ordered.mapInArrow(run, "a long, b long").distinct())


def _members(sets: DataFrame, bound: float) -> DataFrame:
    """A row for each member of each set, as ``_shared`` takes them."""
    size = F.size("hashes")
    # a share of exactly ``bound`` must not be lost to rounding
    least = F.ceil(size * bound - 1e-6).cast("int")
    return sets.select(
        "rep", "sig", F.col("rep").alias("part"), F.lit(True).alias("out"), size.alias("total"), (size * bound / (1 + bound)).alias("need"),
        least.alias("least"), least.alias("least_out"), F.explode("hashes").alias("token"),
    )


def _shared(members: DataFrame) -> DataFrame:
    """A row for each set with ``known``: how often and which of its members come, the rarest first, of those that several sets have."""
    frequent = members.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    of = ["rep", "sig", "part", "out", "total", "need", "least", "least_out", *(c for c in ("hub", "hub_sig") if c in members.columns)]
    return members.join(frequent, "token").groupBy(*of).agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("known"))


def _rare(by_set: DataFrame) -> DataFrame:
    """``(token, freq, rep, sig, part, out, total, own, need, lead)``: of each set the tokens by which it must meet any other it is like.

    A set that has ``least`` of its ``total`` members in common with each set it is like shares one of the first
    total - least + 1 with it, in any order that all sets follow; here the rarest come first. ``own`` counts the members that no
    other set has; those meet nothing and are left out. ``lead`` marks those that ``least_out`` asks for.
    """
    first = lambda least: F.col("total") - F.col(least) + 1 - F.col("own")
    rows = by_set.withColumn("own", F.col("total") - F.size("known")).withColumn("first", first("least").cast("int")).filter("first > 0")
    leading = F.posexplode(F.slice("known", F.lit(1), F.col("first"))).alias("pos", "t")
    return (
        rows.select("rep", "sig", "part", "out", "total", "own", "need", first("least_out").alias("ahead"), leading)
        .select("t.token", F.col("t.n").alias("freq"), "rep", "sig", "part", "out", "total", "own", "need", (F.col("pos") < F.col("ahead")).alias("lead"))
    )


def _held(entries: DataFrame) -> DataFrame:
    """``(token, n, hub)`` of the tokens that sets of several parts have.

    The hub is the set with the smallest share of members of its own: in a group of edited copies that is
    what they were copied from.
    """
    hub = F.struct((F.col("own") / F.col("total")).alias("share"), "rep", "sig", "part", "total", "own", "need")
    held = entries.groupBy("token").agg(F.count("*").alias("n"), F.min(hub).alias("hub"), F.min("part").alias("low"), F.max("part").alias("high"))
    return held.filter("low <> high").select("token", "n", "hub")


def _may_reach(a: str, b: str) -> Column:
    """Whether members of their own leave two sets room for as many common ones as they need."""
    at = lambda c: F.col(f"{a}.{c}"), lambda c: F.col(f"{b}.{c}")
    return F.least(*[x("total") - x("own") for x in at]) >= at[0]("need") + at[1]("need") - 1e-6


def _crowd_pairs(entries: DataFrame, held: DataFrame, crowd: int) -> DataFrame:
    """Pairs of different parts that meet at a token: all where ``crowd`` sets at most have it, else each with the hub.

    Two sets of which both are ``out`` meet at tokens that lead both.
    """
    few, many = entries.join(held.filter(F.col("n") <= crowd).select("token"), "token"), held.filter(F.col("n") > crowd)
    l, r = few.alias("l"), few.alias("r")  # noqa: E741
    leads = ~(F.col("l.out") & F.col("r.out")) | (F.col("l.lead") & F.col("r.lead"))
    apart = (F.col("l.token") == F.col("r.token")) & (F.col("l.rep") < F.col("r.rep")) & (F.col("l.part") != F.col("r.part"))
    pairs = l.join(r, apart & leads & _may_reach("l", "r")).select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b"))
    x, h = entries.alias("x"), many.select("token", F.col("hub.rep").alias("hub"), "hub.part", "hub.total", "hub.own", "hub.need").alias("h")
    star = x.join(h, (F.col("x.token") == F.col("h.token")) & (F.col("x.rep") != F.col("h.hub")) & (F.col("x.part") != F.col("h.part")) & _may_reach("x", "h"))
    return pairs.union(star.select(F.col("h.hub").alias("a"), F.col("x.rep").alias("b")))


def _from_hubs(entries: DataFrame, held: DataFrame, sets: DataFrame, shared: DataFrame, parts: DataFrame, bound: float, crowd: int) -> DataFrame:
    """Sets at crowded tokens as seen from the hub: members that one has and the other has not, as ``_shared`` takes them, written out.

    ``shared`` are all crowded sets. What no other of them has meets nothing in a gap either: it counts in ``total`` and has no row.

    All have been compared with the hub h. Two sets are alike if at most c = (1 - bound) / (1 + bound) of their sizes' sum
    are members of one only. Let x and y be alike and no links lead from one to the other. Then one of them, say x, is out of
    the hub's component and not like h: its gap, what x or h has alone, is over c (|x| + |h|). What x or y has alone is in just
    one of the two gaps, so they have at least (|gap x| - c |x|) / 2 + (|gap y| - c |y|) / 2 members of their gaps in common, which is
    over (1 - c) / 2 of the gap of y. Edits that only one text has are half of such a gap or more: most copies meet nothing.
    """
    c = (1 - bound) / (1 + bound)
    crowded = held.filter(F.col("n") > crowd).select("token", F.col("hub.rep").alias("hub"), F.col("hub.sig").alias("hub_sig"))
    near = entries.select("token", "rep", "sig").join(crowded, "token").filter("rep <> hub or sig <> hub_sig").select("hub", "hub_sig", "rep", "sig").distinct()
    part = lambda k, name: parts.select(F.col("node").alias(k), F.col("component").alias(name))
    placed = near.join(part("rep", "part"), "rep", "left").join(part("hub", "main"), "hub", "left")
    placed = materialize(placed.withColumn("part", F.coalesce("part", "rep")).withColumn("out", F.col("part") != F.coalesce("main", "hub")).drop("main"))
    torn = placed.join(placed.filter("out").select("hub", "hub_sig").distinct(), ["hub", "hub_sig"], "left_semi")
    known = shared.select("rep", "sig", F.col("known.token").alias("known"))
    beside = torn.join(sets.select("rep", "sig", "hashes"), ["rep", "sig"]).join(known, ["rep", "sig"], "left").join(
        sets.select(F.col("rep").alias("hub"), F.col("sig").alias("hub_sig"), F.col("hashes").alias("centre")), ["hub", "hub_sig"])
    lacks = F.array_except("centre", "hashes")
    gaps = beside.withColumn("total", F.size(F.array_except("hashes", "centre")) + F.size(lacks)).withColumn(
        "gap", F.concat(F.coalesce(F.array_except("known", "centre"), F.array().cast("array<long>")), lacks))
    gaps = materialize(gaps.select(
        "hub", "hub_sig", "rep", "sig", "part", "out", "gap", "total", ((F.col("total") - c * F.size("hashes")) / 2).alias("need"),
        ((F.col("total") - c * (F.size("hashes") + F.size("centre"))) / (1 + c)).alias("alone"),
    ))
    others = gaps.filter("out").groupBy("hub", "hub_sig").agg(F.min("need").alias("other"))
    whole = lambda n: F.greatest(F.lit(1), F.ceil(n - 1e-6)).cast("int")
    met = gaps.join(others, ["hub", "hub_sig"]).withColumn("least_out", whole(F.col("need") + F.col("other")))
    # a set in the hub's component is held against those out of it, one out of it against all; a gap of y has no more common members than it has
    met = met.withColumn("least", F.when(F.col("out"), F.least("least_out", whole(F.col("alone")))).otherwise(F.col("least_out"))).filter("least <= total")
    out = materialize(met.select(
        "hub", "hub_sig", "rep", "sig", "part", "out", "total", "need", "least", "least_out", F.explode("gap").alias("token"),
    ).withColumn("token", F.xxhash64("hub", "hub_sig", "token")))
    release(placed)
    release(gaps)
    return out


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: float = SIMILARITY, shingle: int = SHINGLE,
           recall: float = RECALL, max_bucket: int = MAX_BUCKET, crowd: int = CROWD, meetings: int = MEETINGS) -> DataFrame:
    """``(doc_id, component_id)`` for every row: the smallest id that pairs of similarity ``bound`` lead to.

    Null and empty texts have equal sets. Rows of one id are one document, which is like whatever one of its
    texts is like. Rows with a null id link nothing; they get the component of their set, null where no row of it has an
    id. Repeated rows repeat; an empty table gives an empty result; other columns are not carried.
    """
    bits, segments = plan(docs.count(), bound, recall)
    named = materialize(_fingerprints(docs, id_col, text_col, shingle, bits, segments))
    # a set is represented by the smallest id that has it
    reps = materialize(named.filter("doc_id is not null").groupBy("sig", "more").agg(F.min("doc_id").alias("rep"), F.first("lane").alias("lane"), F.first("segments").alias("segments")))
    points = lambda rows: rows.select("rep", F.explode(_points(bits)).alias("key"))
    # points so crowded that a part of the sets shows it are left out of the windows below
    shown = points(reps.filter(F.pmod(F.xxhash64("rep"), F.lit(SHOWN)) == 0)).groupBy("key").count().filter(F.col("count") > max_bucket)
    hot = materialize(shown.select("key"))
    all_points = points(reps)
    if not hot.isEmpty():
        sent = _small(hot)
        crowded = [all_points.join(sent, "key", "left_semi").select("rep").distinct()]
        all_points = all_points.join(sent, "key", "left_anti")
    else:
        crowded = []
    met_at = materialize(all_points.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1"))
    crowded.append(met_at.filter(F.col("n") > max_bucket).select("rep"))
    crowded.append(met_at.groupBy("rep").agg(F.sum(F.col("n") - 1).alias("met")).filter(F.col("met") > meetings).select("rep"))
    crowded_reps = materialize(functools.reduce(DataFrame.union, crowded).distinct())
    lanes = reps.select("rep", "lane").join(crowded_reps.withColumn("crowded", F.lit(True)), "rep", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    near = met_at.filter(F.col("n") <= max_bucket).join(lanes, "rep").select("key", "rep", "lane", "crowded")
    close = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= most(CHECK, bound)
    # two crowded sets are compared the exact way; a set that is not crowded has few meetings, so pairs grow with the sets
    apart = ~(F.col("l.crowded") & F.col("r.crowded")) & (F.col("l.rep") < F.col("r.rep"))
    met = (
        near.alias("l").join(near.alias("r"), (F.col("l.key") == F.col("r.key")) & apart & close(F.col("l.lane"), F.col("r.lane")))
        .select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b")).distinct()
    )
    far = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    of = lambda c: reps.select(F.col("rep").alias(c), F.col("segments").alias(f"s{c}"))
    likely = materialize(met.join(of("a"), "a").join(of("b"), "b").filter(far <= most(bits * segments, bound)).select("a", "b").distinct())
    asked = likely.select(F.col("a").alias("rep")).union(likely.select("b")).union(crowded_reps).distinct()
    asked = materialize(asked.join(reps.select("rep", "sig", "more"), "rep"))
    texts = docs.join(_small(asked.select(F.col("rep").alias("__tl_rep"))), F.col(id_col).cast("long") == F.col("__tl_rep"), "left_semi")
    sets = _sets(texts, id_col, text_col, shingle).withColumnRenamed("doc_id", "rep").join(asked, ["rep", "sig", "more"], "left_semi")
    sets = materialize(sets.dropDuplicates(["rep", "sig", "more"]))
    shared = materialize(_shared(_members(sets.join(crowded_reps, "rep", "left_semi"), bound)))
    entries = materialize(_rare(shared))
    held = materialize(_held(entries))
    asked_pairs = materialize(likely.union(_crowd_pairs(entries, held, crowd)).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = _compared(asked_pairs, sets, bound)
    # rows of one id with several texts tie those texts' groups
    several = named.filter("doc_id is not null").join(reps.select("sig", "more", "rep"), ["sig", "more"]).groupBy("doc_id").agg(F.min("rep").alias("src"), F.collect_set("rep").alias("reps")).filter("size(reps) > 1")
    ties = several.select("src", F.explode("reps").alias("dst")).filter("src <> dst")
    edges = materialize(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(ties))
    parts = materialize(connected_components(edges))
    used = [named, reps, hot, met_at, crowded_reps, likely, asked, sets, shared, entries, held, asked_pairs, links, edges]
    for more in range(ROUNDS, 0, -1):
        seen = _from_hubs(entries, held, sets, shared, parts, bound, crowd)
        used.append(seen)
        if seen.isEmpty():
            break
        entries = materialize(_rare(_shared(seen)))
        held = materialize(_held(entries))
        # what is still crowded is seen from hubs once more; the last round expands it
        met = _crowd_pairs(entries, held, crowd if more > 1 else 1 << 62).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        unseen = materialize(met.join(asked_pairs, ["a", "b"], "left_anti"))
        used += [entries, held, unseen]
        if not unseen.isEmpty():
            asked_pairs = asked_pairs.union(unseen)
            found = _compared(unseen, sets, bound)
            used.append(found)
            if not found.isEmpty():
                used.append(parts)
                edges = edges.union(found.select(F.col("a").alias("src"), F.col("b").alias("dst")))
                parts = materialize(connected_components(edges))
    least = materialize(reps.join(parts, F.col("rep") == F.col("node"), "left").select("sig", "more", F.coalesce("component", "rep").alias("component_id")))
    out = materialize(named.select("doc_id", "sig", "more").join(least, ["sig", "more"], "left").select("doc_id", "component_id"))
    for done in (*used, parts, least):
        release(done)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Keep the document with the smallest id of each group that pairs of similarity ``bound`` connect; columns stay as they are.

    Rows with a null id stay, as nothing can name them. Of several rows with
    one id all stay: they are one document. The table of groups is read when the result is, and stays in the shared folder.
    """
    gone = groups(docs, id_col, text_col, **options).filter("doc_id <> component_id").select(F.col("doc_id").alias("__tl_gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__tl_gone"), "left_anti")
