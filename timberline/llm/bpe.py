"""Byte-level BPE: encoding by segment trees over adjacent pair ranks, and decoding.

Each leaf of a word's tree holds the rank of the pair that begins there, and
each inner node the least (rank, position) below it. The root is therefore
the leftmost pair of lowest rank; a merge changes three leaves, each in
logarithmic time, until the root says that no pair is left. Short words are
merged many at a time, one row of a matrix for each tree; long ones
(``LONG`` bytes and more) have a tree of their own.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.tables import slices

#: Fixed value: the pre-tokenizer pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 64
#: Entries kept in a worker's memory between batches.
CACHE_ENTRIES = 300_000
#: Pieces and words that ``encode`` carries from slice to slice, at most.
HELD = 150_000
_NONE = np.int64(1) << 62
_ODD_SPACE = re.compile(r" (?=\s|$)")
_SPLIT = re.compile(r" (?=\S)")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class ByteBpe:
    """A vocabulary file of the tokenizers library with byte-level BPE and no normalizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self._pairs = {(a, b): r for r, (a, b) in reversed(list(enumerate(zip(left.tolist(), right.tolist()))))}
        self._bits = 18
        self._table()
        self._split = regex.compile(PATTERN)
        self._words: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}  # what follows a space, without that space

    def _table(self) -> None:
        """Open addressing for pair ranks, probed for whole arrays at once."""
        size = 1 << self._bits
        self._slot_key = np.full(size, -1, np.int64)
        self._slot_rank = np.full(size, _NONE, np.int64)
        for (a, b), r in self._pairs.items():
            key = a << 32 | b
            h = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self._bits)
            while self._slot_key[h] != -1:
                h = (h + 1) % size
            self._slot_key[h], self._slot_rank[h] = key, r

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; a value above all ranks where there is no such merge."""
        key = a << 32 | b
        h = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)
        out = np.full(len(key), _NONE, np.int64)
        got = self._slot_key[h]
        out = np.where(got == key, self._slot_rank[h], out)
        open_ = np.flatnonzero((got != key) & (got != -1))
        while len(open_):
            h[open_] = (h[open_] + 1) & ((1 << self._bits) - 1)
            got = self._slot_key[h[open_]]
            same = got == key[open_]
            out[open_[same]] = self._slot_rank[h[open_[same]]]
            open_ = open_[~same & (got != -1)]
        return out

    def merge_many(self, items: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of each item; items shorter than ``LONG`` bytes share their steps."""
        out: list = [b""] * len(items)
        groups: dict[int, list[int]] = {}
        for i, item in enumerate(items):
            n = len(item)
            if n >= LONG:
                out[i] = self.merge_long(item)
            elif n:
                groups.setdefault(max(2, 1 << (n - 1).bit_length()), []).append(i)
        for width, members in groups.items():
            step = max(1, 1_000_000 // width)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self._merge_rows([items[i] for i in part], width)):
                    out[i] = ids
        return out

    def _merge_rows(self, items: list[bytes], width: int) -> list[bytes]:
        n = len(items)
        lengths = np.fromiter(map(len, items), np.int64, n)
        inside = np.arange(width) < lengths[:, None]
        sym = np.zeros((n, width + 1), np.int64)
        sym[:, :width][inside] = self.byte_id[np.frombuffer(b"".join(items), np.uint8)]
        alive = inside.copy()
        after = np.tile(np.arange(1, width + 2, dtype=np.int64), (n, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int64), (n, 1))
        tree = np.full((n, 2 * width), _NONE, np.int64)
        paired = np.arange(width) < lengths[:, None] - 1
        r, c = np.nonzero(paired)
        rank = self.ranks(sym[r, c], sym[r, c + 1])
        some = rank < _NONE
        tree[r[some], width + c[some]] = rank[some] * width + c[some]
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        flat = tree.ravel()
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            root = tree[rows, 1]
            i = root % width
            j = after[rows, i]
            sym[rows, i] = self.made[root // width]
            alive[rows, j] = False
            k = after[rows, j]
            after[rows, i] = k
            has_next = k < lengths[rows]
            before[rows[has_next], k[has_next]] = i[has_next]
            p = before[rows, i]
            has_prev = p >= 0
            base = rows * (2 * width)
            flat[base + width + j] = _NONE
            value = np.full(len(rows), _NONE, np.int64)
            rank = self.ranks(sym[rows[has_next], i[has_next]], sym[rows[has_next], k[has_next]])
            value[has_next] = np.where(rank < _NONE, rank * width + i[has_next], _NONE)
            flat[base + width + i] = value
            pr, pp = rows[has_prev], p[has_prev]
            rank = self.ranks(sym[pr, pp], sym[pr, i[has_prev]])
            flat[base[has_prev] + width + pp] = np.where(rank < _NONE, rank * width + pp, _NONE)
            for b, leaf in ((base, j), (base, i), (base[has_prev], pp)):
                node = (width + leaf) >> 1
                up = width
                while up > 1:
                    two = b + 2 * node
                    flat[b + node] = np.minimum(flat[two], flat[two + 1])
                    node >>= 1
                    up >>= 1
            rows = rows[tree[rows, 1] < _NONE]
        ids = sym[:, :width][alive].astype("<u4").tobytes()
        ends = (np.cumsum(alive.sum(axis=1)) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def merge_long(self, item: bytes) -> bytes:
        """One tree for one long item."""
        sym = self.byte_id[np.frombuffer(item, np.uint8)].tolist()
        n = len(sym)
        width = 1 << (n - 1).bit_length()
        none, pairs, made = int(_NONE), self._pairs, self.made.tolist()
        tree = [none] * (2 * width)
        for c in range(n - 1):
            r = pairs.get((sym[c], sym[c + 1]))
            if r is not None:
                tree[width + c] = r * width + c
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf: int, value: int) -> None:
            node = width + leaf
            tree[node] = value
            node >>= 1
            while node:
                best = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == best:
                    break
                tree[node] = best
                node >>= 1

        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            j = after[i]
            k = after[j]
            sym[i], after[i] = made[rank], k
            put(j, none)
            if k < n:
                before[k] = i
                r = pairs.get((sym[i], sym[k]))
                put(i, none if r is None else r * width + i)
            else:
                put(i, none)
            p = before[i]
            if p >= 0:
                r = pairs.get((sym[p], sym[i]))
                put(p, none if r is None else r * width + p)
        out, i = [], 0
        while i < n:
            out.append(sym[i])
            i = after[i]
        return np.array(out, "<u4").tobytes()

    def _learn(self, pieces: list[str], into: dict[str, bytes], lead: str) -> None:
        """Encode pieces and keep them in ``into``."""
        split = self._split.findall
        parts = [split(lead + p) for p in pieces]
        words = self._words
        if len(words) > CACHE_ENTRIES:
            words.clear()
        new = list({w for part in parts for w in part if w not in words})
        words.update(zip(new, self.merge_many([w.encode("utf-8", "surrogatepass") for w in new])))
        for piece, part in zip(pieces, parts):
            into[piece] = b"".join([words[w] for w in part])
        for w in new:
            if len(w) > LONG:
                del words[w]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens. Before a space that a non-space follows, a word always ends."""
        lists = [_SPLIT.split(t) if _ODD_SPACE.search(t) else t.split(" ") for t in texts]
        firsts: dict[str, bytes] = {}
        self._learn(list({c[0] for c in lists}), firsts, "")
        known = self._pieces
        if len(known) > CACHE_ENTRIES:
            known.clear()
        new = set().union(*(c[1:] for c in lists)).difference(known)
        self._learn(list(new), known, " ")
        get = known.__getitem__
        out = [firsts[c[0]] + b"".join(map(get, c[1:])) for c in lists]
        for piece in new:
            if len(piece) > LONG:
                del known[piece]
        return out

    def known(self) -> int:
        return len(self._pieces) + len(self._words)

    def forget(self) -> None:
        """Drop what was learned about words, so that a worker that goes on to other work holds none of it."""
        self._pieces.clear()
        self._words.clear()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, little-endian, 32 bits each; none for null or empty text."""
        if self._cut is None or not any(t and self._cut.search(t) for t in texts):
            return self._plain([t or "" for t in texts])
        parts = [self._cut.split(t or "") for t in texts]
        plain = iter(self._plain([p for part in parts for p in part[::2]]))
        return [
            b"".join(next(plain) if k % 2 == 0 else int(self.special[p]).to_bytes(4, "little") for k, p in enumerate(part))
            for part in parts
        ]

    def decode_bytes(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for, special tokens included."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@functools.lru_cache(2)
def vocabulary(path: str) -> ByteBpe:
    """One per worker and file."""
    return ByteBpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``: the token ids of every whole text as ``array<int>``.

    Null text counts as empty and has no ids. One row for each input row,
    repeated rows included; other columns are not carried.
    """

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            for piece, texts in slices(batch, 1):
                flat = bpe.encode(texts)
                offsets = np.cumsum([0, *(len(x) // 4 for x in flat)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(flat), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "ids"]
                )
                if bpe.known() > HELD:
                    bpe.forget()
        bpe.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` from ids; null ids give null."""

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.array(x, "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again, keeping digests only.

    ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, one row for each input
    row; null text counts as empty.
    """

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            for piece, texts in slices(batch, 1):
                ids = bpe.encode(texts)
                back = [bpe.decode(x).encode() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
