"""Sharding by a hierarchical weighted hash tree.

A document goes down the tree: at the root each region draws for it, in its
region each rack, in its rack each shard. The draw of a child is an exponential
variable made from a hash of the document's id and the child's label, divided
by the child's weight; the least draw wins, so that children win in proportion
to their weights. A child's draw depends on nothing else. Where weights change, a
child that got heavier can only win documents and one that got lighter can only
lose them, and documents whose path no changed subtree touches stay where they are.
A new region of one shard takes documents only into itself.

Placing is one projection with built-in functions: it needs no shuffle. Only the numbering
of rows inside shards exchanges rows, narrow ones, after equal rows were counted together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.session import materialize, release

#: Hexadecimal digits of a draw, and their bits.
DIGITS, BITS = 13, 52
#: Distinct rows of a shard that are numbered by one window group, about.
SLICE = 2_048
#: Equal rows that are numbered by one task.
RUN = 100_000


@dataclass(frozen=True)
class Tree:
    """``weights[region][rack][shard]``: weights of the shards, numbered through in this order.

    Racks and regions weigh what their shards weigh. Shards of weight 0 keep their number and get nothing.
    """

    weights: tuple[tuple[tuple[float, ...], ...], ...]

    def __post_init__(self):
        flat = [w for region in self.weights for rack in region for w in rack]
        if not flat or min(flat) < 0 or not sum(flat) > 0:
            raise ValueError("a tree needs weights of 0 or more, one above 0 at least")

    @classmethod
    def even(cls, shards: int, racks: int = 2, per_rack: int = 2) -> Tree:
        """Full regions of ``racks`` times ``per_rack`` shards of weight 1; what is left over are regions of one shard each."""
        size = racks * per_rack
        full = tuple(tuple((1.0,) * per_rack for _ in range(racks)) for _ in range(shards // size))
        return cls(full + (((1.0,),),) * (shards % size))

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.weights for rack in region)

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region of its own: nothing moves but into it."""
        return Tree((*self.weights, ((weight,),)))

    def levels(self) -> list[list[list[tuple[str, float, int]]]]:
        """For each level the children ``(label, weight, number)`` of each of its nodes, where they have weight."""
        regions, racks, shards = [], [], []
        number = 0
        for r, region in enumerate(self.weights):
            regions.append((f"{r}", float(sum(map(sum, region))), r))
            inside = []
            for k, rack in enumerate(region):
                inside.append((f"{r}.{k}", float(sum(rack)), len(shards)))
                shards.append([(f"{r}.{k}.{s}", float(w), number + s) for s, w in enumerate(rack)])
                number += len(rack)
            racks.append(inside)
        return [[regions], racks, shards]


def draw(key: Column, label: Column) -> Column:
    """An exponential variable of mean 1: minus the logarithm of a hash of key and label as a fraction between 0 and 1."""
    digits = F.substring(F.md5(F.concat(key, F.lit("/"), label).cast("binary")), 1, DIGITS)
    return -F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << BITS))


def _winner(key: Column, children: Column) -> Column:
    """Number of the child with the least draw for its weight."""
    tried = F.transform(children, lambda c: F.struct((draw(key, c["label"]) / c["weight"]).alias("at"), c["to"].alias("to")))
    return F.array_min(tried)["to"]


def descent(tree: Tree, id_col: Column) -> list[Column]:
    """Region, rack and shard of an id as columns; racks are numbered through over all regions. Each column contains those above it."""
    key, at, found = F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(0), []
    for level in tree.levels():
        nodes = [
            F.array(*[F.struct(F.lit(label).alias("label"), F.lit(w).alias("weight"), F.lit(to).alias("to")) for label, w, to in node if w > 0])
            if any(w > 0 for _, w, _ in node) else F.lit(None).cast("array<struct<label:string,weight:double,to:int>>")
            for node in level
        ]
        at = _winner(key, F.get(F.array(*nodes), at) if len(nodes) > 1 else nodes[0])
        found.append(at)
    return found


def place(docs: DataFrame, tree: Tree, id_col: str = "doc_id", names: tuple[str, str, str] = ("region", "rack", "shard")) -> DataFrame:
    """``docs`` with the region, rack and shard of each row, without a shuffle.

    The id and the tree alone decide. Rows with a null id go together to the
    shard of the text ``null``. Repeated rows go together. Columns named like an output give way; other names
    keep them. An empty table gives an empty result.
    """
    region, rack, shard = names
    kids = descent(tree, F.col(id_col))
    return docs.withColumns(dict(zip((region, rack, shard), kids)))


def write_shards(docs: DataFrame, tree: Tree, folder: str, id_col: str = "doc_id", shard_col: str = "shard") -> None:
    """Write whole rows as Parquet, a folder ``shard=K`` for each shard. Large shards are dealt over several files by adaptive execution."""
    placed = place(docs, tree, id_col, ("__tl_region", "__tl_rack", shard_col)).drop("__tl_region", "__tl_rack")
    placed.hint("rebalance", F.col(shard_col)).write.partitionBy(shard_col).parquet(folder)


def numbered(docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack)``: one row for each row of ``docs``.

    ``size`` is the UTF-8 length of the text and 1; a null text has none. ``slot`` numbers
    the rows of a shard from 0 in the order of a hash of id, size and checksum, then of these
    three. Rows equal in all three are counted before they are exchanged and spread again afterwards, so that
    neither a common id nor a common row makes a large group. Null ids are placed like an id
    of their own. Texts may be of any length; other columns, of whatever name, are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    kinds = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    joined = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size", "text_crc32")
    spread = F.conv(F.substring(F.md5(joined.cast("binary")), 1, DIGITS), 16, 10).cast("long")
    shards = place(kinds, tree, names=("region", "rack", "shard"))
    grown = descent(tree.grown(), F.col("doc_id"))[-1]
    placed = materialize(shards.withColumn("grown_shard", grown).withColumn("h", spread))
    # slices by the upper bits of the hash, as many as keep each small
    bits = max(4, (placed.count() // (SLICE * tree.shards)).bit_length())
    sliced = placed.withColumn("slice", F.shiftright("h", BITS - bits))
    totals = sliced.groupBy("shard", "slice").agg(F.sum("n").alias("held"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", "slice", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "slice").orderBy("h", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sliced.withColumn("ahead", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["shard", "slice"])
    first = materialize(ranked.withColumn("first", F.col("start") + F.col("ahead")).drop("h", "slice", "ahead", "start"))
    release(placed)
    # rows that come in great number are cut into runs, which are dealt out
    runs = first.filter(F.col("n") > RUN).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))).alias("at"))
    runs = runs.withColumns({"first": F.col("first") + F.col("at"), "n": F.least(F.col("n") - F.col("at"), F.lit(RUN).cast("long"))}).drop("at")
    few = first.filter(F.col("n") <= RUN).unionByName(runs.repartition("shard", "first"))
    each = few.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return each.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("k")).alias("slot"), "grown_shard", "region", "rack"
    )


def _sql() -> str:
    """DuckDB's text for ``numbered`` with 16 shards: draws as unnested rows, CRC-32 bit by bit."""
    def step(name: str, before: str, tree: Tree) -> str:
        number = lambda i: ", ".join(
            f"({p}, '{label}', CAST({w} AS DOUBLE), {to})" for p, node in enumerate(tree.levels()[i]) for label, w, to in node
        )
        parts, at = [], before
        for i in range(3):
            parent = "0" if i == 0 else "p.node"
            parts.append(
                f"{name}{i} AS (SELECT p.id, arg_min(v.to_, -ln((CAST('0x' || substr(md5(p.id || '/' || v.label), 1, {DIGITS}) AS BIGINT) + 0.5) / {1 << BITS}) / v.w) AS node"
                f" FROM {at} p JOIN (VALUES {number(i)}) v(parent, label, w, to_) ON v.parent = {parent} GROUP BY p.id)"
            )
            at = f"{name}{i}"
        return ",\n".join(parts)

    tree = Tree.even(SHARDS)
    return f"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
bytes AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: CAST('0x' || b AS BIGINT)) AS b FROM documents),
d AS (SELECT doc_id, id, CAST(len(b) + 1 AS BIGINT) AS size, CAST(xor(4294967295, list_reduce(b, lambda c, v: xor(c // 256, t[xor(c % 256, v) + 1]), 4294967295)) AS BIGINT) AS text_crc32 FROM bytes, tab),
ids AS (SELECT DISTINCT id FROM d),
{step("s", "ids", tree)},
{step("g", "ids", tree.grown())},
h AS (SELECT d.*, CAST('0x' || substr(md5(id || ':' || size || ':' || text_crc32), 1, {DIGITS}) AS BIGINT) AS h FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(s2.node AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY s2.node ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
  CAST(g2.node AS INTEGER) AS grown_shard, CAST(s0.node AS INTEGER) AS region, CAST(s1.node AS INTEGER) AS rack
FROM h JOIN s0 USING (id) JOIN s1 USING (id) JOIN s2 USING (id) JOIN g2 USING (id)
"""


#: Shards of the registered query.
SHARDS = 16
SQL = _sql()
