"""Ranked lexical search by windowed bucket scoring.

Texts are cut into terms once. Each document leaves one narrow row: its length and, of
the terms that any query asks for, those it holds with their counts. These rows are
dealt into index shards of some ``SHARD`` documents and ``POSTINGS`` entries. A shard orders its documents by id,
inverts them into postings, and walks them in windows of ``WINDOW`` documents: for
each query the postings of its terms that lie in the window are added into an array
that fits a cache, a bitset marks what was touched, and what is marked is harvested into the
query's heap. Heaps of all shards are merged by Spark.

Queries come to the shards as rows too, in blocks, so that a large query set makes more
groups and not larger ones.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.tables import slices
from timberline.session import materialize, release

K = 50
#: Documents of a window: sums of 32 kB.
WINDOW = 1 << 12
#: Documents of an index shard and its postings, about, at most.
SHARD, POSTINGS = 1 << 15, 1 << 21
#: Terms of the queries of one block, about.
BLOCK = 1 << 18
#: Query terms that are sent to the tasks that cut texts; more are joined.
SENT_TERMS = 200_000
#: Numbers that documents are dealt by, task by task in turn.
DEALT = 1 << 20

#: Upper case becomes lower case, and ASCII bytes that are neither letters nor digits become blanks.
_PLAIN = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of digits, letters and non-ASCII characters of a UTF-8 text, only A-Z lower-cased."""
    return (text or b"").translate(_PLAIN).split()


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(qid, term)``: distinct terms of each query; rows of one id are one query."""

    def run(batches):
        for batch in batches:
            for piece, texts in slices(batch, 1):
                found = [sorted(set(terms(t.encode()))) if t else [] for t in texts]
                rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
                flat = pa.array([x for f in found for x in f], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(rows, pa.int64())), flat], names=["qid", "term"])

    rows = queries.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("qid"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "qid long, term binary").distinct()


def _indexed(docs: DataFrame, id_col: str, text_col: str, known: dict[bytes, int] | None) -> DataFrame:
    """``(deal, doc_id, n, found)``: length and counted terms of each row; ``found`` holds numbers of terms, or the terms where none are known here."""
    kind = pa.binary() if known is None else pa.int32()

    def run(batches):
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId() * 7919
        for batch in batches:
            for piece, texts in slices(batch, 1):
                n, sizes, found, counts = [], [], [], []
                for t in texts:
                    words = terms(t.encode() if t else None)
                    held = Counter(words) if known is None else Counter(filter(known.__contains__, words))
                    n.append(len(words))
                    sizes.append(len(held))
                    found.extend(held if known is None else map(known.__getitem__, held))
                    counts.extend(held.values())
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                both = pa.StructArray.from_arrays([pa.array(found, kind), pa.array(counts, pa.int32())], names=["term", "tf"])
                deal = (turn + np.arange(len(n))) % DEALT
                turn += len(n)
                yield pa.RecordBatch.from_arrays([pa.array(deal), piece.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, both)], names=["deal", "doc_id", "n", "found"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"deal long, doc_id long, n long, found array<struct<term:{'binary' if known is None else 'int'},tf:int>>")


def weight(n_docs: int, df: Column) -> Column:
    return F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2 * df + 1)))


class Heap:
    """The k best of what comes: highest scores, of equal scores the smaller id."""

    def __init__(self, k: int):
        self.k = k
        self.kept: list[tuple[int, int]] = []

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(self.kept) == self.k:
            fit = scores >= self.kept[0][0]
            ids, scores = ids[fit], scores[fit]
        if len(ids) > self.k:  # no more than k can enter, with all that tie with the k-th
            fit = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[fit], scores[fit]
        for doc, score in zip(ids.tolist(), scores.tolist()):
            if len(self.kept) < self.k:
                heapq.heappush(self.kept, (score, -doc))
            elif (score, -doc) > self.kept[0]:
                heapq.heapreplace(self.kept, (score, -doc))


class Postings:
    """An inverted shard: for each term the places of its documents, ascending, with what they add for a weight of 1."""

    def __init__(self, terms: np.ndarray, places: np.ndarray, parts: np.ndarray):
        order = np.lexsort((places, terms))
        self.places, self.parts = places[order], parts[order]
        names, starts = np.unique(terms[order], return_index=True)
        ends = np.append(starts[1:], len(order))
        self.at = dict(zip(names.tolist(), zip(starts.tolist(), ends.tolist())))

    def window(self, term: int, low: int, high: int) -> slice:
        start, end = self.at.get(term, (0, 0))
        a, b = np.searchsorted(self.places[start:end], (low, high))
        return slice(start + int(a), start + int(b))


def search(postings: Postings, ids: np.ndarray, queries: list[tuple[int, np.ndarray, np.ndarray]], k: int, window: int) -> dict[int, Heap]:
    """Heaps of the queries ``(qid, terms, weights)`` over the documents ``ids`` of a shard, window by window."""
    sums, touched = np.zeros(window, np.int64), np.zeros(-(-window // 64), np.uint64)
    heaps = {q: Heap(k) for q, _, _ in queries}
    one = np.uint64(1)
    for low in range(0, len(ids), window):
        cut = {t: postings.window(t, low, low + window) for t in postings.at}
        cut = {t: s for t, s in cut.items() if s.stop > s.start}
        marks = {}
        for t, s in cut.items():
            at = (postings.places[s] - low).astype(np.uint64)
            bits = np.zeros_like(touched)
            np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), one << (at & np.uint64(63)))
            marks[t] = bits
        for q, asked, weights in queries:
            for t, w in zip(asked.tolist(), weights.tolist()):
                s = cut.get(t)
                if s is not None:
                    sums[postings.places[s] - low] += w * postings.parts[s]
                    touched |= marks[t]
            hit = np.flatnonzero(np.unpackbits(touched.view(np.uint8), bitorder="little"))
            if len(hit):
                found = sums[hit]
                heaps[q].offer(ids[low + hit[found > 0]], found[found > 0])
                sums[hit] = 0
                touched[:] = 0
    return heaps


def rank(docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id",
         query_text: str = "text", window: int = WINDOW, shard: int = SHARD, postings: int = POSTINGS, block: int = BLOCK, sent: int = SENT_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each query its ``k`` best documents with a score above 0.

    Equal scores are ranked by ascending ``doc_id``. Every row with an id is a document: rows of one id
    are ranked each by its own text, repeated rows repeat. Rows with a null id count in the corpus' statistics and
    are not returned, as nothing names them. A null or empty text has no term. Queries
    of one id are one query; those with a null id or without a term known to the corpus give no
    rows. Empty tables give an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    schema = "item_id long, rank int, doc_id long, score long"
    asked = materialize(query_terms(queries, query_id, query_text))
    wanted = asked.select("term").distinct()
    size = wanted.count()
    if not size:
        return spark.createDataFrame([], schema)
    known = {bytes(r["term"]): i for i, r in enumerate(wanted.orderBy("term").collect())} if size <= sent else None
    rows = materialize(_indexed(docs, id_col, text_col, known))
    n_docs, length = rows.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    each = rows.select(F.explode("found").alias("f")).select("f.term", "f.tf")
    if known is None:
        each = each.join(wanted, "term", "left_semi")
    counts = materialize(each.groupBy("term").agg(F.count("*").alias("df")))
    if known is None:
        lists = asked.join(counts, "term")
    else:
        numbers = spark.createDataFrame([(bytearray(t), i) for t, i in known.items()], "name binary, term int")
        lists = asked.withColumnRenamed("term", "name").join(numbers, "name").join(counts, "term")
    through = lambda n: (F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    held, entries = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("found")), F.lit(0))).first()
    groups = max(1, -(-held // shard), -(-entries // postings))
    weighed = lists.withColumn("w", weight(n_docs, F.col("df"))).filter("w > 0")
    blocks = max(1, -(-weighed.count() // block))
    per_query = weighed.groupBy("qid").agg(F.collect_list(F.struct("term", "w")).alias("asked"))
    right = per_query.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks))).withColumn("g", F.explode(F.sequence(*through(groups))))
    left = rows.filter("doc_id is not null and size(found) > 0").withColumn("g", F.pmod("deal", F.lit(groups)))
    left = left.select("g", "doc_id", "n", "found").withColumn("block", F.explode(F.sequence(*through(blocks))))

    def score(index, queries):
        out = {"qid": [], "doc_id": [], "score": []}
        if len(index) and len(queries):
            index = index.sort_by("doc_id").combine_chunks()
            found = index.column("found").combine_chunks()
            sizes = np.diff(found.offsets.to_numpy())
            flat = found.flatten()
            names, tf = flat.field("term"), flat.field("tf").to_numpy().astype(np.int64)
            mine = [(q, [a["term"] for a in asked], [a["w"] for a in asked]) for q, asked in zip(queries.column("qid").to_pylist(), queries.column("asked").to_pylist())]
            number = {t: i for i, t in enumerate(sorted({t for _, asked, _ in mine for t in asked}))}
            if pa.types.is_binary(names.type):
                coded = names.dictionary_encode()
                table = np.array([number.get(t, -1) for t in coded.dictionary.to_pylist()], np.int64)
                numbers = table[coded.indices.to_numpy()]
            else:
                table = np.full(max([*number, int(names.to_numpy().max(initial=0))]) + 1, -1, np.int64)
                table[list(number)] = list(number.values())
                numbers = table[names.to_numpy()]
            n = index.column("n").to_numpy()
            m = 50 + (50 * n * n_docs) // length
            parts = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, sizes))
            places = np.repeat(np.arange(len(n)), sizes)
            inside = numbers >= 0
            inverted = Postings(numbers[inside], places[inside], parts[inside])
            coded = [(q, np.array([number[t] for t in asked]), np.array(w, np.int64)) for q, asked, w in mine]
            for q, heap in search(inverted, index.column("doc_id").to_numpy(), coded, k, window).items():
                for s, doc in sorted(heap.kept, reverse=True):
                    out["qid"].append(q)
                    out["doc_id"].append(-doc)
                    out["score"].append(s)
        return pa.table(out, schema=pa.schema([("qid", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]))

    best = left.groupBy("g", "block").cogroup(right.groupBy("g", "block")).applyInArrow(score, "qid long, doc_id long, score long")
    best = materialize(best.select("*", F.pmod(F.xxhash64("doc_id", "score"), F.lit(64)).alias("some")))
    order = [F.desc("score"), F.col("doc_id")]
    fewer = best.withColumn("r", F.row_number().over(Window.partitionBy("qid", "some").orderBy(*order))).filter(F.col("r") <= k).drop("r")
    ranked = fewer.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).filter(F.col("rank") <= k)
    for done in (asked, rows, counts):
        release(done)
    return ranked.select(F.col("qid").alias("item_id"), "rank", "doc_id", "score")


#: DuckDB's text for ``rank`` with 50 documents an item.
SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
stats AS (SELECT count(*) AS big_n, CAST(sum(len(t)) AS BIGINT) AS big_l FROM d WHERE len(t) > 0),
tf AS (SELECT k, doc_id, term, n, count(*) AS tf FROM (SELECT k, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((CAST(2 AS DOUBLE) * big_n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, stats),
scored AS (
  SELECT item_id, k, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), stats GROUP BY item_id, k, doc_id
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0 AND doc_id IS NOT NULL)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
