"""Helpers the operators share: Arrow slices of bounded size, hashed words, tables written between jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.session import TABLES, checkpoint_dir, drop, prepare, read_by, written  # noqa: F401

U64 = np.uint64
#: Bytes of text that one numpy step works on, small enough to stay in a core's cache; longer single texts are worked on in blocks cut between words.
SLICE_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows a task writes at least, where all cores have a task.
ROWS_PER_TASK = 200_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of at most ``rows`` rows in as few partitions as these need, but one a core; no shuffle, rows stay whole."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK)))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A fixed odd 64-bit value for every byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64)) | U64(1)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, up to ``n - 1``."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def blank_separators() -> np.ndarray:
    """Bytes 0x20 and 0x09 to 0x0D end a word."""
    t = np.zeros(256, bool)
    t[[0x20, 9, 10, 11, 12, 13]] = True
    return t


def letter_separators() -> np.ndarray:
    """Every ASCII byte but letters and digits ends a word."""
    t = np.ones(256, bool)
    for lo, hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
        t[lo:hi] = False
    return t


LOWER, BLANKS, NON_LETTERS = lower_table(), blank_separators(), letter_separators()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_large_binary(column.type) and not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    o = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0]:o[-1]], o - o[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of the batches a few megabytes of text at a time, at least one row each, with bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_buffers(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo), data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
            lo = hi


def _block_words(b: np.ndarray, inside: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(last) + 1
    if not len(s):
        return s, e, np.zeros(0, U64)
    up, down = powers(len(b))
    total = np.zeros(len(b) + 1, U64)
    np.cumsum(BYTE_VALUE[b] * up, out=total[1:])
    return s, e, mix((total[e] - total[s]) * down[s] + (e - s).astype(U64))


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows: start and end byte, 64-bit hash of the A-Z lower-cased bytes, and per row the first word's number.

    Worked on in blocks of ``SLICE_BYTES`` cut at separators, so memory follows the words, not the bytes.
    """
    n = len(data)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lo = 0
    while lo < n:
        hi = min(n, lo + SLICE_BYTES)
        while hi < n:  # the cut has to stand behind a separator or between rows
            near = np.flatnonzero(separators[data[lo:hi]])
            row = int(offsets[np.searchsorted(offsets, hi, "right") - 1])
            cut = max(lo + int(near[-1]) + 1 if len(near) else lo, row)
            if cut > lo:
                hi = cut
                break
            hi = min(n, hi + SLICE_BYTES)
        b = LOWER[data[lo:hi]]
        first = np.zeros(hi - lo, bool)
        inner = offsets[(offsets >= lo) & (offsets < hi)]
        first[inner - lo] = True
        s, e, h = _block_words(b, ~separators[b], first)
        found.append((s + lo, e + lo, h))
        lo = hi
    s, e, h = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64))
    return s, e, h, np.searchsorted(s, offsets)


def row_id(name: str = "doc_id"):
    return F.col(name).cast("bigint").alias(name)
