"""Substring deduplication with automata of repeated phrases.

Documents are dealt into blocks by a hash. Hashes find out what recurs; where it
occurs is found by automata over the words themselves.

1. Each block names its phrase keys: of every window of 13 words the least
   hash among its six-word phrases. Equal windows have equal keys, and a
   document has about two keys for nine words. Keys that a second document
   shares are sent back to the blocks that hold them.
2. Windows with a shared key are named by 96 bits and counted. Those that start
   in several documents are confirmed; the smallest document is their owner.
   Nothing is kept of where else they stand.
3. The owners cut their confirmed windows out of their texts: runs of them are
   the recurring passages of the corpus, each written out once, with its owner.
4. A passage is dealt to the blocks that named one of its windows. Each block
   compiles what it got into automata of bounded size, shard by shard, and
   streams all its documents through every shard. Each occurrence of a
   passage, or of a part that is a window long, is located there, and it goes
   where the passage's owner is a smaller document.

A block sends one row for each key or window however many of its documents
hold it, so a phrase of a third of all documents is as many rows as there
are blocks. Documents with equal word sequences are compared once, as wholes.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.tables import slices

WINDOW = 13
PHRASE = 6
BLOCK_BYTES = 16 << 20
#: Words of the passages in one automaton, about (those of one passage at least).
AUTOMATON_WORDS = 1_000_000
#: Windows of a passage at most; longer runs are several passages that overlap.
PASSAGE_WINDOWS = 512
#: Places that a chunk of a passage may come from before whole windows take its place.
CROWD = 16
_NO_ID = (1 << 63) - 1  # rows without an id come after all others
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_KEYS = "kind int, a long, b long, block int, many boolean, doc long"
_WINDOWS = "a long, b int, block int, many boolean, doc long"
_PASSAGES = "low long, pid long, packed binary, names array<struct<a: long, b: int>>"


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, unchanged."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    return x ^ (x >> np.uint64(29))


def _rolled(h: np.ndarray, size: int, factor: np.uint64) -> np.ndarray:
    n = len(h) - size + 1
    out = h[:n].copy()
    for k in range(1, size):
        out = out * factor + h[k : k + n]
    return _mix(out)


def window_keys(h: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """For each window the least hash of its phrases."""
    grams = _rolled(h, phrase, _A)
    span, out, reach = window - phrase + 1, grams, 1
    while reach < span:
        step = min(reach, span - reach)
        out = np.minimum(out[:-step], out[step:])
        reach += step
    return out


def window_names(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits for each window, as 64 and 32."""
    return _rolled(h, window, _A), (_rolled(_mix(h ^ _B), window, _B) >> np.uint64(32))


def _whole(ws: list[bytes]) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(b" ".join(ws))
    a, b = np.frombuffer(d, "<i8")
    return int(a), int(b) or 1


def _pack(docs: DataFrame) -> DataFrame:
    """Texts compressed for the way to their blocks, which several passes read."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for piece, texts in slices(batch, 2):
                packed = pa.array([pack((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), packed], names=["doc_id", "block", "packed"])

    return docs.mapInArrow(run, "doc_id long, block int, packed binary")


def _each(table: pa.Table):
    """Documents of a block: ids for comparison, ids as they are, words."""
    ids, unpack = table.column("doc_id").to_pylist(), zstandard.ZstdDecompressor().decompress
    for k, packed in enumerate(table.column("packed")):
        yield (_NO_ID if ids[k] is None else ids[k]), ids[k], unpack(packed.as_py()).split()


def _least(a: np.ndarray, b: np.ndarray, doc: np.ndarray):
    """Distinct (a, b) with the smallest document and whether there are several."""
    order = np.lexsort((doc, b, a))
    a, b, doc = a[order], b[order], doc[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a))[: len(first)] - 1
    return a[first], b[first], doc[first], doc[last] != doc[first]


def _key_table(kind: int, block: int, a, b, doc, many) -> pa.Table:
    n = len(a)
    return pa.table(
        {
            "kind": pa.array(np.full(n, kind, np.int32)),
            "a": pa.array(a.view(np.int64)),
            "b": pa.array(b.view(np.int64)),
            "block": pa.array(np.full(n, block, np.int32)),
            "many": pa.array(many, pa.bool_()),
            "doc": pa.array(doc, pa.int64()),
        }
    )


def _stack(parts: list, kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def dedup_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE,
                  block_bytes: int = BLOCK_BYTES, digest: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: documents without repeated passages.

    A word goes if a window of ``window`` words covers it whose word sequence
    also starts in a document with a smaller id; windows are judged on the
    input. ``kept`` holds the other words joined by single spaces, or with
    ``digest`` their SHA-256 as ``kept_sha256``. Null and empty texts have no
    words. Rows without an id count as coming after all with one, and not as
    repeats of each other; nor do rows that share an id. One row for each
    input row; other columns are not carried.
    """
    if not 1 <= phrase <= window:
        raise ValueError("a phrase is a part of a window")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // block_bytes))
    block = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(blocks)).cast("int")
    texts = _pack(rows.select("doc_id", block.alias("block"), "text"))

    def name_keys(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        keys, owners, wholes = [], [], []
        for doc, _, ws in _each(table):
            if len(ws) >= window:
                k = np.unique(window_keys(_hashes(ws), window, phrase))
                keys.append(k)
                owners.append(np.full(len(k), doc, np.int64))
                wholes.append((*_whole(ws), doc))
        a = _stack(keys, np.uint64)
        a, b, doc, many = _least(a, np.zeros(len(a), np.uint64), _stack(owners, np.int64))
        w = np.array(wholes, np.int64).reshape(-1, 3)
        wa, wb, wdoc, wmany = _least(w[:, 0].copy().view(np.uint64), w[:, 1].copy().view(np.uint64), w[:, 2])
        # the document of a phrase key is of no use further on
        return pa.concat_tables([_key_table(0, block, a, b, [None] * len(a), many), _key_table(1, block, wa, wb, wdoc, wmany)])

    together = Window.partitionBy("kind", "a", "b")
    named = texts.groupBy("block").applyInArrow(name_keys, _KEYS)
    shared = (
        named.withColumn("n", F.count("*").over(together)).withColumn("low", F.min("doc").over(together)).filter("n > 1 or many")
        .select("kind", "a", "b", "block", "low", "n")
    )

    def name_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        out_a, out_b, owners = [], [], []
        block = left.column("block")[0].as_py() if left.num_rows else 0
        keys, firsts = _shared(right) if left.num_rows and right.num_rows else (np.zeros(0, np.uint64), {})
        for doc, _, ws in _each(left) if len(keys) else ():
            if len(ws) < window or (firsts and firsts.get(_whole(ws), doc) < doc):
                continue
            h = _hashes(ws)
            hit = _member(window_keys(h, window, phrase), keys)
            if hit.any():
                a, b = window_names(h, window)
                out_a.append(a[hit])
                out_b.append(b[hit])
                owners.append(np.full(int(hit.sum()), doc, np.int64))
        a, b, doc, many = _least(_stack(out_a, np.uint64), _stack(out_b, np.uint64), _stack(owners, np.int64))
        return pa.table(
            {
                "a": pa.array(a.view(np.int64)),
                "b": pa.array(b.astype(np.uint32).view(np.int32)),
                "block": pa.array(np.full(len(a), block, np.int32)),
                "many": pa.array(many, pa.bool_()),
                "doc": pa.array(doc, pa.int64()),
            }
        )

    # dealt out once, for counting and for sending passages
    windows = texts.groupBy("block").cogroup(shared.drop("n").groupBy("block")).applyInArrow(name_windows, _WINDOWS)
    # both uses have this filter, which the join implies, and thus the same exchange
    windows = windows.filter("a is not null and b is not null").repartition("a", "b")
    confirmed = (
        windows.groupBy("a", "b").agg(F.min(F.struct("doc", "block")).alias("own"), F.max("doc").alias("top"), F.bool_or("many").alias("many"))
        .filter("own.doc < top or many").select("a", "b", F.col("own.block").alias("block"), F.col("own.doc").alias("low"))
    )

    def cut_passages(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            a, b, low = right.column("a").to_numpy().view(np.uint64), right.column("b").to_numpy().view(np.uint32), right.column("low").to_numpy()
            order = np.lexsort((b, a))
            known, owners = (a[order], b[order], low[order]), set(np.unique(low).tolist())
            for doc, _, ws in _each(left):
                if doc in owners and len(ws) >= window:
                    out += _runs(ws, doc, window, known)
        lows, pids, packed, names = zip(*out) if out else ((),) * 4
        return pa.table({
            "low": pa.array(lows, pa.int64()), "pid": pa.array(pids, pa.int64()), "packed": pa.array(packed, pa.binary()),
            "names": pa.array(names, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int32())]))),
        })

    def windows_of(batches):
        for b in batches:
            names = b.column(3)
            at = pa.array(np.repeat(np.arange(b.num_rows), np.diff(names.offsets.to_numpy())))
            flat = names.flatten()
            yield pa.RecordBatch.from_arrays([b.column(1).take(at), b.column(0).take(at), flat.field(0), flat.field(1)], names=["pid", "low", "a", "b"])

    def texts_of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), b.column(2)], names=["pid", "low", "packed"])

    # both read all columns, so that passages are cut and dealt out once
    passages = texts.groupBy("block").cogroup(confirmed.groupBy("block")).applyInArrow(cut_passages, _PASSAGES).repartition("pid")
    starts = passages.mapInArrow(windows_of, "pid long, low long, a long, b int")
    # a block that knows a window from its owner alone has nothing to remove
    wanted = starts.join(windows, ["a", "b"]).filter("doc > low or many").select("pid", "block").distinct()
    none = F.lit(None)
    sent = wanted.join(passages.mapInArrow(texts_of, "pid long, low long, packed binary"), "pid").select(
        "block", "low", "packed", none.cast("long").alias("a"), none.cast("long").alias("b")
    )
    # the condition on the count keeps the filter above the window function, whose input is thus computed once
    wholes = shared.filter(F.when(F.col("n") > 0, F.col("kind")) == 1).select("block", "low", none.cast("binary").alias("packed"), "a", "b")

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        firsts, found, unpack = {}, [], zstandard.ZstdDecompressor().decompress
        for low, packed, a, b in zip(*(right.column(c).to_pylist() for c in ("low", "packed", "a", "b"))) if right.num_rows else ():
            if packed is None:
                firsts[a, b] = low
            else:
                found.append((low, unpack(packed).split()))
        out, streamed = [], []
        for doc, own, ws in _each(left):
            gone = np.zeros(len(ws), bool)
            if len(ws) >= window:
                if firsts and firsts.get(_whole(ws), doc) < doc:
                    gone[:] = True
                else:
                    streamed.append((doc, ws, gone))
            out.append((own, ws, gone))
        locate(found, streamed, window)
        kept = [b" ".join([w for w, g in zip(ws, gone.tolist()) if not g]) if gone.any() else b" ".join(ws) for _, ws, gone in out]
        return pa.table(
            {
                "doc_id": pa.array([o for o, _, _ in out], pa.int64()),
                "n_words": pa.array([len(ws) for _, ws, _ in out], pa.int64()),
                "n_removed": pa.array([int(g.sum()) for _, _, g in out], pa.int64()),
                last: pa.array([hashlib.sha256(x).hexdigest() if digest else x.decode("utf-8", "surrogatepass") for x in kept], pa.string()),
            }
        )

    last = "kept_sha256" if digest else "kept"
    return texts.groupBy("block").cogroup(sent.union(wholes).groupBy("block")).applyInArrow(
        remove, f"doc_id long, n_words long, n_removed long, {last} string"
    )


def _shared(right: pa.Table) -> tuple[np.ndarray, dict]:
    """Sorted phrase keys, and the first ids of whole documents."""
    kind, a, b = (right.column(c).to_numpy() for c in ("kind", "a", "b"))
    whole = kind == 1
    low = right.column("low").to_pylist()
    firsts = {(x, y): low[k] for k, x, y in zip(np.flatnonzero(whole).tolist(), a[whole].tolist(), b[whole].tolist())}
    return np.unique(a[~whole].view(np.uint64)), firsts


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def _owned(a: np.ndarray, b: np.ndarray, doc: int, known: tuple) -> np.ndarray:
    """Whether ``doc`` is the owner of each of its windows."""
    ka, kb, klow = known
    at = np.searchsorted(ka, a)
    out = np.zeros(len(a), bool)
    open_ = np.arange(len(a))
    while len(open_):  # windows whose first 64 bits agree stand side by side
        open_ = open_[at[open_] < len(ka)]
        open_ = open_[ka[at[open_]] == a[open_]]
        same = kb[at[open_]] == b[open_]
        out[open_[same]] = klow[at[open_[same]]] == doc
        open_ = open_[~same]
        at[open_] += 1
    return out


def _runs(ws: list[bytes], doc: int, window: int, known: tuple) -> list[tuple]:
    """``(low, pid, packed words, names of its windows)`` of each passage that ``doc`` owns."""
    a, b = window_names(_hashes(ws), window)
    own = _owned(a, b, doc, known)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
    a, b = a.view(np.int64).tolist(), b.astype(np.uint32).view(np.int32).tolist()
    out = []
    for first, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        for k in range(first, end, PASSAGE_WINDOWS):
            stop = min(k + PASSAGE_WINDOWS, end)
            text = b" ".join(ws[k : stop + window - 1])
            pid = xxhash.xxh3_64_intdigest(text, doc & 0xFFFFFFFFFFFFFFFF)
            out.append((doc, pid - (1 << 64) if pid >> 63 else pid, zstandard.compress(text, 1),
                        [{"a": x, "b": y} for x, y in zip(a[k:stop], b[k:stop])]))
    return out


def shards(passages: list[tuple[int, list[int]]], window: int, limit: int, crowd: int):
    """Automata over word ids, one after the other, each of some passages, with what its patterns stand for.

    Every window holds exactly one of the chunks of ``(window + 1) // 2`` words that a
    passage is cut into from its beginning; chunks are the patterns, with the
    passages and places they come from. A chunk that comes from more than
    ``crowd`` places gives way to the windows around them, with their owners.
    """
    half = (window + 1) // 2
    at = 0
    while at < len(passages):
        begin, size = at, 0
        chunks: dict[tuple, list] = {}
        while at < len(passages) and (at == begin or size < limit):
            ids = passages[at][1]
            for k in range(0, len(ids) - half + 1, half):
                chunks.setdefault(tuple(ids[k : k + half]), []).append((at, k))
            size += len(ids)
            at += 1
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for chunk, places in chunks.items():
            if len(places) <= crowd:
                automaton.add_word(chunk, places)
                continue
            for i, k in places:
                low, ids = passages[i]
                for first in range(max(0, k + half - window), min(k, len(ids) - window) + 1):
                    automaton.add_word(tuple(ids[first : first + window]), low)
        automaton.make_automaton()
        yield automaton


def _stretches(ids: np.ndarray, keys: np.ndarray, open_: np.ndarray, size: int, margin: int) -> list[tuple[int, int]]:
    """Beginnings and ends of the parts of a document around runs of ``size`` words whose hash is among ``keys``; ``open_`` marks their first bits."""
    if len(ids) < size:
        return []
    hashes = _rolled(ids, size, _A)
    at = np.flatnonzero(open_[(hashes >> np.uint64(42)).astype(np.int64)])
    at = at[_member(hashes[at], keys)]
    if not len(at):
        return []
    begin, end = np.maximum(at - margin, 0), np.minimum(at + size + margin, len(ids))
    cut = np.flatnonzero(begin[1:] > end[:-1]) + 1
    return list(zip(begin[np.append(0, cut)].tolist(), end[np.append(cut - 1, len(at) - 1)].tolist()))


def locate(passages: list[tuple[int, list[bytes]]], docs: list[tuple[int, list[bytes], np.ndarray]], window: int,
           limit: int = AUTOMATON_WORDS, crowd: int = CROWD) -> None:
    """Stream every document through every shard and mark what windows of smaller owners cover.

    A chunk found in a document is extended to both sides as far as the words
    of the passage go on; what is a window long or longer is an occurrence. Of a document only stretches around
    places whose hash is that of a chunk are streamed: every pattern holds one.
    """
    letters: dict[bytes, int] = {}
    known = [(low, [letters.setdefault(w, len(letters) + 1) for w in ws]) for low, ws in sorted(passages, key=lambda p: p[1])]
    if not known:
        return
    get, half = letters.get, (window + 1) // 2
    keys = np.unique(np.concatenate([_rolled(np.array(ids, np.uint64), half, _A)[::half] for _, ids in known if len(ids) >= half] or [np.zeros(0, np.uint64)]))
    open_ = np.zeros(1 << 22, bool)
    open_[(keys >> np.uint64(42)).astype(np.int64)] = True
    coded = []
    for doc, ws, gone in docs:
        ids = [get(w, 0) for w in ws]
        parts = _stretches(np.array(ids, np.uint64), keys, open_, half, window - half)
        if parts:
            coded.append((tuple(ids), parts, doc, gone))
    for automaton in shards(known, window, limit, crowd):
        for words_, parts, doc, gone in coded:
            reached: dict[tuple[int, int], int] = {}
            for end, places in ((a + end, places) for a, b in parts for end, places in automaton.iter(words_[a:b])):
                if type(places) is int:  # a whole window, and its owner
                    if places < doc:
                        gone[end - window + 1 : end + 1] = True
                    continue
                for i, k in places:
                    low, passage = known[i]
                    way = (i, end - k)
                    if low >= doc or reached.get(way, -1) >= end:
                        continue
                    right, to = end + 1, k + half
                    while right < len(words_) and to < len(passage) and words_[right] == passage[to]:
                        right += 1
                        to += 1
                    left, to = end - half, k - 1
                    while left >= 0 and to >= 0 and words_[left] == passage[to]:
                        left -= 1
                        to -= 1
                    reached[way] = right - 1
                    if right - left - 1 >= window:
                        gone[left + 1 : right] = True
