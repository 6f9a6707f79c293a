"""What the operators of this subpackage share: inputs, splits, Arrow text buffers, word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rideops.session import cut_lineage

#: Separators of words: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch; a batch also ends at ``BATCH_BYTES``.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Narrow rows (an id and a flag or two) that are broadcast at most, some 80 MB where they are hashed.
BROADCAST_ROWS = 2_000_000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measured(ids: DataFrame) -> DataFrame:
    """A narrow table, checkpointed and counted: hinted for broadcast if it has ``BROADCAST_ROWS`` rows at most, else left to a shuffled join."""
    ids = cut_lineage(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def fold_of(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % folds


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array and their n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + n + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0]:at[-1]], at - at[0]


def runs_of(offsets: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of documents holding about ``limit`` bytes, one document at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its tasks, next to those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(work: Callable) -> Callable:
    """A function for mapInArrow that gives memory back when its task ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def tidy_group(work: Callable) -> Callable:
    """A function of a key and a table for applyInArrow that gives memory back after each group."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        try:
            return work(key, table)
        finally:
            give_back()

    return run


def tidy_pair(work: Callable) -> Callable:
    """As :func:`tidy_group`, for the two tables of a cogroup."""
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return work(key, left, right)
        finally:
            give_back()

    return run


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor, shift and multiply)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15


def _powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        take = min(have, n - have)
        out[have:have + take] = out[:take] * step
        have += take
    return out


class WordHasher:
    """64-bit hashes of all words of a byte array at once.

    A word's hash is the difference of two prefix sums of byte * base^position, brought back to
    position 0 by the inverse power (the base is odd), then finalised together with its length.
    """

    def __init__(self) -> None:
        self._up = self._down = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, stem: int = 0) -> tuple[np.ndarray, ...]:
        """Start, end and hash of every word, and with ``stem`` also of its first so many bytes."""
        n = len(data)
        if n > len(self._up):
            size = max(n, 1 << 16)
            self._up, self._down = _powers(size, _BASE), _powers(size, pow(_BASE, -1, 1 << 64))
        inside = np.ones(n + 2, bool)
        inside[0] = inside[-1] = False
        inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._up[:n], out=prefix[1:])
        out, back = [start, end], self._down[np.minimum(start, max(n - 1, 0))]
        for stop in (end, np.minimum(start + stem, end))[:1 + (stem > 0)]:
            out.append(mixed((prefix[stop] - prefix[start]) * back + (stop - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
        return tuple(out)
