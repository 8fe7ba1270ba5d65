"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions.

The tagger (``tagger``) is trained in numpy from labelled spans (``spans``). It
reads every text whole, in overlapping windows; the spans of all windows of a
document are then reconciled at once, by the choice of non-overlapping spans
with the greatest weight. What the patterns find always stays; the tagger
adds what lies elsewhere, on its own decision. Only numbers are checked
as numbers: parts of an address, check digits of a card, digits of a telephone.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.llm.spans import KINDS, luhn
from timberline.llm.tables import slices
from timberline.llm.tagger import O_TAG, PAD, Tagger, codes, trained

#: Characters of a window and from one to the next. Where the tagger has a span near a window's end, a window
#: around that end is read as well, in which a span of ``MAX_SPAN`` lies whole.
WINDOW, STRIDE = 320, 272
#: A span that begins or ends so near a window's end may be a part of a longer one.
NEAR = 24
#: Windows decoded at once.
ROWS = 512
#: Least mean probability of a span's tags, and the most characters of a span.
MIN_SURE, MAX_SPAN = 0.9, 96
_TRIGGER = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a number starts where no digit stands before it, which changes no match
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the fixed patterns, ordered by kind, then start."""
    out, end, at = [], 0, text.find("@")
    if not _TRIGGER.search(text):
        return out
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        d = _digits(m.group()) if m.end() - m.start() <= 40 else ""
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            out.append((3, *m.span()))
    return out


# ---------------------------------------------------------------- documents


def _spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of tags of one kind; a first-character tag opens a new run."""
    out, kind, start = [], -1, 0
    for t, tag in enumerate([*tags.tolist(), O_TAG]):
        k = (tag - 1) // 2 if tag else -1
        if kind >= 0 and (k != kind or tag == 1 + 2 * k):
            out.append((kind, start, t))
            kind = -1
        if k >= 0 and kind < 0:
            kind, start = k, t
    return out


def reconcile(candidates: dict[tuple[int, int, int], float]) -> list[tuple[int, int, int]]:
    """The non-overlapping spans of greatest total weight."""
    spans = sorted(candidates, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    best: list[tuple[float, int, int]] = [(0.0, -1, 0)]  # weight, span taken last, state before it
    for k, s in enumerate(spans):
        j = bisect.bisect_right(ends, s[1], 0, k)
        with_it = best[j][0] + candidates[s]
        best.append((with_it, k, j) if with_it > best[-1][0] else (best[-1][0], -1, k))
    out, k = [], len(spans)
    while k > 0:
        _, taken, before = best[k]
        if taken >= 0:
            out.append(spans[taken])
        k = before
    return out[::-1]


def consistent(kind: int, s: str) -> bool:
    """Whether the numbers in a span are such as its kind has, whatever its form."""
    if kind == KINDS.index("ip"):
        return all(int(p) <= 255 for p in re.findall("[0-9]{1,9}", s)) or ":" in s
    if kind == KINDS.index("card"):
        return 13 <= len(d := _digits(s)) <= 19 and luhn(d)
    return kind != KINDS.index("phone") or 7 <= len(_digits(s)) <= 15


def windows(text: str) -> np.ndarray:
    """Symbols of all windows of a text, one row each."""
    c = codes(text)
    n = 1 + max(0, -(-(len(c) - WINDOW) // STRIDE))
    padded = np.full((n - 1) * STRIDE + WINDOW, PAD, np.uint8)
    padded[: len(c)] = c
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def around_end(start: int) -> int:
    """Start of the window in whose middle a window that starts at ``start`` and the one before it overlap."""
    return max(0, start + (WINDOW - STRIDE) // 2 - WINDOW // 2)


def tagged(model: Tagger, texts: list[str]) -> list[dict[tuple[int, int, int], float]]:
    """Spans of the tagger in all windows of each text, with their weights."""
    held: list[dict] = [{} for _ in texts]
    rows, owners, size = [], [], 0
    open_em, open_who = [], []  # windows that may hold a span
    again: set[tuple[int, int]] = set()  # texts and starts of windows around ends that a span is near

    def search():
        nonlocal open_em, open_who
        em, who = np.concatenate(open_em), np.concatenate(open_who)
        open_em, open_who = [], []
        tags = model.best_path(em)
        hit = np.flatnonzero(tags.any(axis=1))
        for r, sure in zip(hit.tolist(), model.certainty(em[hit], tags[hit]) if len(hit) else ()):
            i, at = int(who[r, 0]), int(who[r, 1])
            room = min(WINDOW, len(texts[i]) - at)
            for kind, a, b in _spans_of(tags[r, :room]):
                before, after = a == 0 and at > 0, b == WINDOW and at + b < len(texts[i])
                if a < NEAR and at > 0:
                    again.add((i, around_end(at)))
                if b > WINDOW - NEAR and at + WINDOW < len(texts[i]):
                    again.add((i, around_end(at + STRIDE)))
                s = float(sure[a:b].mean())
                if s >= MIN_SURE and b - a <= MAX_SPAN:
                    key = (kind, at + a, at + b)
                    held[i][key] = held[i].get(key, 0.0) + s * (b - a) * (0.2 if before or after else 1.0)

    def flush():
        nonlocal rows, owners, size
        if not size:
            return
        em, who = model.emissions(np.concatenate(rows)), np.concatenate(owners)
        rows, owners, size = [], [], 0
        some = model.open_rows(em)
        if len(some):
            open_em.append(em[some])
            open_who.append(who[some])
        if sum(map(len, open_em)) >= ROWS // 2:
            search()

    def add(i, x, starts):
        nonlocal size
        if size + len(x) > ROWS:
            flush()
        rows.append(x)
        owners.append(np.stack([np.full(len(x), i), starts], axis=1))
        size += len(x)

    def finish():
        flush()
        if open_em:
            search()

    for i, text in enumerate(texts):
        x = windows(text)
        for k in range(0, len(x), ROWS):
            part = x[k : k + ROWS]
            add(i, part, (k + np.arange(len(part))) * STRIDE)
    finish()
    ends, again = sorted(again), set()
    for i, at in ends:
        c = codes(texts[i][at : at + WINDOW])
        x = np.full((1, WINDOW), PAD, np.uint8)
        x[0, : len(c)] = c
        add(i, x, np.array([at]))
    finish()
    return held


def added_spans(model: Tagger, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list]:
    """Spans that the tagger adds to the base spans of each text: those that overlap none of them."""
    out = []
    for text, found, fixed in zip(texts, tagged(model, texts), base):
        taken: list[list[int]] = []
        for a, b in sorted((a, b) for _, a, b in fixed):
            if taken and a < taken[-1][1]:
                taken[-1][1] = max(b, taken[-1][1])
            else:
                taken.append([a, b])
        stops = [b for _, b in taken]
        ok = {}
        for s, w in found.items():
            k = bisect.bisect_right(stops, s[1])  # the first that ends after the start
            if (k == len(taken) or taken[k][0] >= s[2]) and consistent(s[0], text[s[1] : s[2]]):
                ok[s] = w
        out.append(reconcile(ok))
    return out


def find(model: Tagger, texts: list[str | None]) -> list[tuple[list, list]]:
    """Base spans and all spans of each text, both ordered by kind and start."""
    some = [i for i, t in enumerate(texts) if t]
    base = [base_spans(texts[i]) for i in some]
    out: list[tuple[list, list]] = [([], [])] * len(texts)
    for i, b, more in zip(some, base, added_spans(model, [texts[i] for i in some], base)):
        out[i] = (b, sorted([*b, *more]))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each run of overlapping spans gives way to the name of its first kind in brackets."""
    out, end = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[0])):
        if merged and a < merged[-1][2]:
            merged[-1] = [min(kind, merged[-1][0]), merged[-1][1], max(b, merged[-1][2])]
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[end:a], f"[{KINDS[kind].upper()}]"]
        end = b
    return "".join(out) + text[end:]


def find_pii(docs: DataFrame, model: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for every row.

    Counts and digest are those of the fixed patterns; ``spans`` adds the
    tagger's. Null and empty texts have no spans. Offsets are code points of
    the whole text, ends exclusive. Repeated rows repeat; an empty table
    stays empty; other columns are not carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches):
        for b in batches:
            for piece, texts in slices(b, 1):
                found = find(shared.value, texts)
                counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        *(pa.array(c, pa.int64()) for c in counts),
                        pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()),
                        pa.array([joined(all_) for _, all_ in found], pa.string()),
                    ],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string")


def redact_pii(docs: DataFrame, model: Tagger | None = None, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """Replace all spans in ``text_col``; ``length_col``, if named and there, gets the new length. Null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)

    def run(batches):
        for b in batches:
            for piece, texts in slices(b, at):
                new = [t if t is None or not s else redact(t, s) for t, (_, s) in zip(texts, find(shared.value, texts))]
                columns = list(piece.columns)
                columns[at] = pa.array(new, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.mapInArrow(run, T.StructType(schema.fields))
    return out if length_col not in docs.columns else out.withColumn(length_col, F.length(text_col).cast(schema[length_col].dataType))
