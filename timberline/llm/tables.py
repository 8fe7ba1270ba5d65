"""Shared pieces: reading a table, walking Arrow batches, bounded samples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, mod ``mod``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % mod


def slices(batch: pa.RecordBatch, text_at: int, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut a batch so that each piece holds about ``limit`` bytes of text (one text at least).

    Yields each piece with its texts (None where null).
    """
    column = batch.column(text_at)
    if pa.types.is_large_string(column.type) or pa.types.is_string(column.type):
        sizes = pc.binary_length(column).to_pylist()
    else:
        sizes = [0] * len(column)
    at, held = 0, 0
    for i, n in enumerate(sizes):
        n = n or 0
        if i > at and held + n > limit:
            piece = batch.slice(at, i - at)
            yield piece, piece.column(text_at).to_pylist()
            at, held = i, 0
        held += n
    if at < len(sizes):
        piece = batch.slice(at)
        yield piece, piece.column(text_at).to_pylist()


def hash_bound(limit: int, total: int) -> int:
    """The signed 64-bit value below which the share ``limit / total`` of all hashes lies; never so low that it is none."""
    return max(1, (limit << 64) // total) - (1 << 63)


def bounded_sample(df: DataFrame, limit: int, seed: int = 7) -> DataFrame:
    """About ``limit`` rows at most, chosen by a hash of the row: the same rows on every run, also where many share an id.

    The whole hash is compared, so that the sample of a table of any size has about ``limit`` rows. Of
    rows that are equal one is drawn.
    """
    total = df.count()
    if total <= limit:
        return df
    drawn = df.filter(F.xxhash64(F.lit(seed), *df.columns) < F.lit(hash_bound(limit, total)))
    return drawn.distinct()
