"""Token ids as length-delimited binary records, with an index for shuffled reads.

A part file is a run of records: length (8 bytes), masked checksum of those
bytes (4), payload, masked checksum of the payload (4); all little-endian.
The payload holds the document's id (8 bytes signed) and its token ids, in
16 bits each where the vocabulary allows, else in 32; the first byte of the
file's name after the dash says which. Beside each part lies an index:
document id, offset, and number of tokens, 8 bytes each, one row a record.
The file ``parts.json`` lists the parts in order; only what it lists belongs to the
data, so that a lost task leaves nothing behind that a reader would take up.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.tables import slices
from timberline.session import scratch_dir

#: Entries kept in a worker's memory between batches, at most before a slice.
CACHE_ENTRIES = 1_000_000
#: Text that one part file holds, about.
PART_BYTES = 256 << 20
_SPACE, _ODD = re.compile(r"[ \t\n\r]+"), re.compile(r"[\x1c-\x1f]")
_PLAIN = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]{1,64}")
_END = re.compile(r"(?<=[a-z\xdf-\xf6\xf8-\xff])([.,])(?=[ \n]|$)")


def masked(data: bytes) -> int:
    """CRC-32, rotated by 15 bits and shifted by a constant, so that checksums of checksums do no harm."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def read_record(f) -> bytes | None:
    """The next payload; None at the end. Raises ValueError where a checksum does not hold."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError("damaged record length")
    size = struct.unpack("<Q", head[:8])[0]
    body = f.read(size + 4)
    if len(body) < size + 4 or struct.unpack("<I", body[size:])[0] != masked(body[:size]):
        raise ValueError("damaged record")
    return body[:size]


class Words:
    """Ids by the tokenizers library, which sees each run of non-space once.

    The vocabulary's normalizer maps characters without regard to what lies
    beyond a space, and no token spans a space, so a text's ids are those of
    its runs put together. Plain words (lower-case letters below U+0100) go to
    the library many at a time; each ends with the one token that bears the
    end-of-word suffix.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size()
        vocab = self.library.get_vocab()
        self._last = np.zeros(max(vocab.values(), default=0) + 1, bool)
        for token, i in vocab.items():
            self._last[i] = token.endswith("</w>")
        self._known: dict[str, bytes] = {}

    def _alone(self, runs: list[str]) -> list[bytes]:
        coded = self.library.encode_batch_fast(runs, add_special_tokens=False)
        return [np.array(c.ids, "<u4").tobytes() for c in coded]

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of plain lower-cased words."""
        ids = np.array(self.library.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = ((np.flatnonzero(self._last[ids]) + 1) * 4).tolist()
        if len(ends) != len(words) or ends[-1] != 4 * len(ids):
            return self._alone(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, runs: list[str]) -> None:
        known = self._known
        plain = [r for r in runs if _PLAIN.fullmatch(r)]
        for k in range(0, len(plain), 2_000):
            part = plain[k : k + 2_000]
            known.update(zip(part, self._together(part)))
        rest = [r for r in runs if r not in known]
        for k in range(0, len(rest), 20_000):
            known.update(zip(rest[k : k + 20_000], self._alone(rest[k : k + 20_000])))

    def _runs(self, text: str | None) -> list[str]:
        """Runs of non-space that the library may see one by one.

        Texts below U+0100 are lower-cased first, as the normalizer will do,
        and a lone mark at a word's end becomes a run of its own, as the
        pre-tokenizer will have it; special tokens are cut from the text as it
        was, so texts that may hold one are left alone.
        """
        if not text:
            return []
        if "<|" not in text and (text.isascii() or _narrow(text)):
            text = _END.sub(r" \1", text.lower())
        # str.split() takes U+001C to U+001F for space, the vocabulary doesn't
        return _SPACE.split(text) if _ODD.search(text) else text.split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, little-endian, 32 bits each."""
        lists = [self._runs(t) for t in texts]
        known = self._known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        new = list(set().union(*lists).difference(known))
        self._learn(new)
        get = known.__getitem__
        out = [b"".join(map(get, ws)) for ws in lists]
        for w in new:
            if len(w) > 64:
                del known[w]
        return out


def _narrow(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@functools.lru_cache(2)
def vocabulary(path: str) -> Words:
    return Words(path)


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    """A filesystem that both driver and executors reach, and the folder's path on it."""
    uri = folder if "://" in folder else re.sub(r"^file:/*", "file:///", folder) if folder.startswith("file:") else f"file://{os.path.abspath(folder)}"
    return pafs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id",
                  text_col: str = "text", part_bytes: int = PART_BYTES) -> list[dict]:
    """Encode whole texts and write part files with their indexes in ascending order of id.

    Rows are dealt by ranges of ids, so that the parts in order hold the
    documents in order; within a part a task streams, one slice of texts at a
    time. A part holds about ``part_bytes`` of text. Each attempt of a task writes
    files of its own name, and those whose task was counted are listed in
    ``parts.json``, which is written last: nothing is renamed, and a repeated
    task disturbs nothing. Rows with a null
    id come first and are written as the least 64-bit integer. Null text
    counts as empty. Rows of one id follow each other by a hash of the text.
    Returns one small row for each part: name, documents, tokens.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // part_bytes))
    # the text's hash splits an id that a large share of the rows has
    keyed = rows.withColumn("h", F.xxhash64("t"))
    dealt = keyed.repartitionByRange(n, "i", "h").sortWithinPartitions("i", "h").select("i", "t")
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches):
        words = vocabulary(tokenizer)
        bits = 16 if words.size <= 1 << 16 and (end_id or 0) < 1 << 16 else 32
        store, base = _open(folder)
        ctx = TaskContext.get()
        name = f"part-{'h' if bits == 16 else 'w'}{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        own = f"{base}/{name}"
        at = docs_ = tokens = 0
        wrote = False
        with store.open_output_stream(own + ".rec") as f, store.open_output_stream(own + ".idx") as x:
            for batch in batches:
                for piece, texts in slices(batch, 1):
                    index = []
                    for i, ids in zip(piece.column(0).to_pylist(), words.encode(texts)):
                        ids += tail
                        i = -(1 << 63) if i is None else i
                        body = np.frombuffer(ids, "<u4").astype("<u2").tobytes() if bits == 16 else ids
                        record = frame(struct.pack("<q", i) + body)
                        f.write(record)
                        index.append(struct.pack("<qQQ", i, at, len(ids) // 4))
                        at += len(record)
                        docs_ += 1
                        tokens += len(ids) // 4
                    x.write(b"".join(index))
                    wrote = wrote or bool(index)
        if wrote:
            yield pa.RecordBatch.from_pylist([{"part": name, "docs": docs_, "tokens": tokens}])
        else:
            for kind in (".rec", ".idx"):
                store.delete_file(own + kind)

    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    done = dealt.mapInArrow(run, "part string, docs long, tokens long").collect()
    parts = [r.asDict() for r in sorted(done, key=lambda r: r["part"])]
    with store.open_output_stream(f"{base}/parts.json") as f:
        f.write(json.dumps(parts).encode())
    return parts


def read_parts(folder: str) -> list[dict]:
    """The parts of a folder that ``write_records`` filled."""
    store, base = _open(folder)
    with store.open_input_stream(f"{base}/parts.json") as f:
        return json.loads(f.read())


def read_records(spark, folder: str, parts: list[dict], slice_bytes: int = 4 << 20) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every record, from the files.

    ``start`` counts the ids of all documents before in the order of the
    files; the checksum is that of the ids in 32 bits. Each task streams its
    parts and verifies every frame.
    """
    before, rows = 0, []
    for p in parts:
        rows.append((p["part"], before))
        before += p["tokens"]
    schema = "part string, before long"
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    table = spark.createDataFrame(rows, schema).repartition(len(rows))

    def run(batches):
        store, base = _open(folder)
        for batch in batches:
            for part, start in zip(*(c.to_pylist() for c in batch.columns)):
                wide = np.dtype("<u2" if part.startswith("part-h") else "<u4")
                out: list[tuple] = []
                with store.open_input_stream(f"{base}/{part}.rec", buffer_size=slice_bytes) as f:
                    while (payload := read_record(f)) is not None:
                        ids = np.frombuffer(payload, wide, offset=8).astype("<u4")
                        i = struct.unpack_from("<q", payload)[0]
                        out.append((None if i == -(1 << 63) else i, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(out) == 10_000:
                            yield _rows(out)
                            out = []
                yield _rows(out)

    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = zip(*out) if out else ([],) * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_at(folder: str, part: str, offset: int) -> tuple[int | None, list[int]]:
    """One record by its index entry: document id and token ids."""
    store, base = _open(folder)
    with store.open_input_file(f"{base}/{part}.rec") as f:
        f.seek(offset)
        payload = read_record(f)
    i = struct.unpack_from("<q", payload)[0]
    wide = np.dtype("<u2" if part.startswith("part-h") else "<u4")
    return (None if i == -(1 << 63) else i), np.frombuffer(payload, wide, offset=8).astype(int).tolist()


def index(spark, folder: str, parts: list[dict]) -> DataFrame:
    """``(part, doc_id, offset, n_tokens)`` of every record: what a shuffled reader sorts at random."""
    schema = "part string, doc_id long, offset long, n_tokens long"
    if not parts:
        return spark.createDataFrame([], schema)

    def run(batches):
        store, base = _open(folder)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{part}.idx") as f:
                    while raw := f.read(24 * 50_000):
                        rows = np.frombuffer(raw, [("i", "<i8"), ("o", "<u8"), ("n", "<u8")])
                        null = rows["i"] == -(1 << 63)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([part] * len(rows)), pa.array(rows["i"], mask=null), pa.array(rows["o"].astype(np.int64)), pa.array(rows["n"].astype(np.int64))],
                            names=["part", "doc_id", "offset", "n_tokens"],
                        )

    table = spark.createDataFrame([(p["part"],) for p in parts], "part string").repartition(len(parts))
    return table.mapInArrow(run, schema)


def write_and_read(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Write records in ``folder`` (one of its own in the shared folder by default) and read them back."""
    spark = docs.sparkSession
    folder = folder or f"{scratch_dir(spark)}/records-{uuid.uuid4().hex}"
    return read_records(spark, folder, write_records(docs, folder, tokenizer, **options))
