"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a few megabytes of documents inside a task. Its words become ids
of the benchmark's vocabulary; a suffix that leaves that vocabulary before
the shortest test window ends can match nothing and is left out of the
array. The other suffixes are sorted, and every test suffix finds its range
by binary search. Ids are interned, not hashed, so matches are verbatim.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.llm.tables import slices
from timberline.session import materialize, release

WINDOW = 10
#: Text of test items that one broadcast may hold (its windows take some ten times as much); more items are dealt into several passes, one after the other.
BLOCK_BYTES = 8 << 20

_WORD = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c in _WORD else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class TestSuffixes:
    """Beginnings of the suffixes of the test items, interned: of full length, and whole shorter items.

    Equal ones are one row; ``first`` bounds each row's places, which are an item and a position in it.
    """

    __test__ = False

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.names: list[str | None] = []
        found: dict[int, list] = defaultdict(list)
        for at, (name, text) in enumerate(items):
            self.names.append(name)
            seq = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)], np.uint32)
            n = min(window, len(seq))
            if n:
                rows = np.lib.stride_tricks.sliding_window_view(seq, n)
                found[n].append((rows, np.full(len(rows), at, np.int64), np.arange(len(rows))))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted(found):
            rows, item, position = (np.concatenate(x) for x in zip(*found[n]))
            keys = self.keys(rows, 0)
            order = np.argsort(keys, kind="stable")
            new = np.ones(len(keys), bool)
            new[1:] = keys[order][1:] != keys[order][:-1]
            self.by_length[n] = (rows[order][new], np.append(np.flatnonzero(new), len(keys)), item[order], position[order])
        self.shortest = min(self.by_length, default=0)

    def keys(self, rows: np.ndarray, pad: int) -> np.ndarray:
        """Rows of ids as byte strings that sort as the sequences do."""
        full = np.full((len(rows), self.window), pad, dtype=">u4")
        full[:, : rows.shape[1]] = rows
        return np.ascontiguousarray(full).view(f"S{4 * self.window}").ravel()


def search(tests: TestSuffixes, texts: list) -> list[tuple]:
    """For each text of the shard: words, hit intervals, items, longest match (words, at, item)."""
    docs = [words(t) for t in texts]
    counts = [len(d) for d in docs]
    plain = [(n, [], [], 0, None, None) for n in counts]
    if not tests.by_length or not sum(counts):
        return plain
    get = tests.ids.get
    starts = np.cumsum([0, *(n + 1 for n in counts)])
    ids = np.zeros(starts[-1] + tests.window, np.int64)  # 0: other words and the gaps between documents
    for a, d in zip(starts, docs):
        ids[a : a + len(d)] = np.fromiter((get(w, 0) for w in d), np.int64, len(d))
    stops = np.flatnonzero(ids == 0)
    run = stops[np.searchsorted(stops, np.arange(len(ids)))] - np.arange(len(ids))
    suffixes = np.flatnonzero(run >= tests.shortest)
    if not len(suffixes):
        return plain
    rows = ids[suffixes[:, None] + np.arange(tests.window)]
    rows[np.arange(tests.window) >= run[suffixes][:, None]] = 0
    keys = tests.keys(rows, 0)
    order = np.argsort(keys, kind="stable")
    keys, array = keys[order], suffixes[order]
    hits: dict[int, list] = defaultdict(list)  # document: (position, length, places in items)
    for n, (windows, first, item, position) in tests.by_length.items():
        low = np.searchsorted(keys, tests.keys(windows, 0), "left")
        high = np.searchsorted(keys, tests.keys(windows, 0xFFFFFFFF if n < tests.window else 0), "right")
        for k in np.flatnonzero(high > low):
            at = array[low[k] : high[k]]
            places = list(zip(item[first[k] : first[k + 1]].tolist(), position[first[k] : first[k + 1]].tolist()))
            for p, d in zip(at.tolist(), (np.searchsorted(starts, at, "right") - 1).tolist()):
                hits[d].append((p - int(starts[d]), n, places))
    for d, found in hits.items():
        found.sort(key=lambda x: x[:2])
        spans: list[list[int]] = []
        items: set[int] = set()
        ends: dict[tuple[int, int], list[int]] = {}  # (item, diagonal): start and end of the match that goes on
        best = (0, 0, -1)
        for p, n, places in found:
            if spans and p <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], p + n)
            else:
                spans.append([p, p + n])
            for item, j in places:
                items.add(item)
                m = ends.get((item, p - j))
                if m is None or p > m[1] - n + 1:
                    m = ends[item, p - j] = [p, p + n]
                m[1] = max(m[1], p + n)
                if m[1] - m[0] > best[0]:
                    best = (m[1] - m[0], m[0], item)
        named = sorted({tests.names[i] for i in items if tests.names[i] is not None})
        plain[d] = (counts[d], [tuple(s) for s in spans], named, best[0], best[1], tests.names[best[2]])
    return plain


_OUT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("longest", T.LongType()),
    T.StructField("longest_at", T.LongType()),
    T.StructField("longest_item", T.StringType()),
]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> list[DataFrame]:
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("t is not null")
    size = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = -(-int(size) // limit)
    return [rows] if n <= 1 else [rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) for k in range(n)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, prefix: str = "") -> DataFrame:
    """Append what each row of ``docs`` shares verbatim with the test items.

    ``n_words``; ``hits``: intervals of word positions inside occurrences of
    test windows; ``items``: the ids of items that have a window here, sorted;
    the longest verbatim match with its place and item. A match is at least a
    window long (or a whole shorter item): suffixes are searched by their first ``window``
    words, and where the following suffix of an item matches the following word, the match goes on.
    Only items are broadcast, a block of proven size at a time; with several
    blocks each is a pass of its own, whose outcome is written before
    the next block is fetched. Null text has no words; an item whose id is null counts
    for hits but cannot be listed; items without words and an empty benchmark
    match nothing. Outputs are named with ``prefix``; input columns named like one are replaced.
    """
    names = [prefix + f.name for f in _OUT]
    kept = docs.drop(*[n for n in names if n != text_col])
    columns_in = kept.columns
    at, width = columns_in.index(text_col), len(columns_in)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, f.dataType) for n, f in zip(names, _OUT))])
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    context = docs.sparkSession.sparkContext

    def one_pass(df: DataFrame, shared, first: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                for piece, texts in slices(batch, at):
                    found = search(shared.value, texts)
                    if not first:
                        old = zip(*(piece.column(width + k).to_pylist() for k in range(len(_OUT))))
                        found = [_joined(a, b) for a, b in zip(old, found)]
                    columns = [pa.array([f[k] for f in found], schema_arrow[k]) for k in range(len(_OUT))]
                    yield pa.RecordBatch.from_arrays(
                        [*(piece.column(k) for k in range(width)), *columns], names=[*columns_in, *names]
                    )

        return df.mapInArrow(run, schema)

    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema_arrow = [pa.int64(), pa.list_(span), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string()]
    out, before = kept, None
    for k, block in enumerate(blocks):
        shared = context.broadcast(TestSuffixes([(r["i"], r["t"]) for r in block.collect()], window))
        out = one_pass(out, shared, k == 0)
        if len(blocks) > 1:
            out = materialize(out)
            shared.destroy()
            release(before)
            before = out
    return out


def _joined(old: tuple, new: tuple) -> tuple:
    spans: list[list[int]] = []
    for a, b in sorted([(s["start"], s["end"]) for s in old[1]] + list(new[1])):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    longest = old[3:] if old[3] >= new[3] else new[3:]
    return (new[0], [tuple(s) for s in spans], sorted({*old[2], *new[2]}), *longest)


def n_hit(column: str = "hits"):
    """Number of words in the intervals."""
    return F.aggregate(column, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Drop the rows that hold an occurrence of a test window; columns stay as they are, whatever their names."""
    marked = find_contamination(docs, benchmark, text_col, prefix="__tl_", **options)
    return marked.filter(F.size("__tl_hits") == 0).select(docs.columns)
