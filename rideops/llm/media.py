"""Media columns: texts stored as FLAC streams, read back and described."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rideops.llm import flac
from rideops.llm.common import runs_of, text_bytes

BLOCK = 576
SCHEMA = ("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
          "media_sha256 string, feature string, media binary")


def payload_of(text: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Bytes of a text, filled up with 255 to a positive multiple of the block, as signed samples."""
    out = np.full(max(1, -(-len(text) // block)) * block, 255, np.uint8)
    out[:len(text)] = text
    return (out ^ 128).view(np.int8)


def features(samples: np.ndarray) -> str:
    """Peak, energy, zero crossings and mean level of decoded samples, all integers."""
    v = samples.astype(np.int64)
    crossings = int(((v[1:] < 0) != (v[:-1] < 0)).sum())
    return f"n={len(v)};peak={int(np.abs(v).max())};energy={int((v * v).sum())};crossings={crossings};sum={int(v.sum())}"


def media_columns(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Store each text (null: empty) as a FLAC stream, read the stored bytes back, describe them.

    One row per input row, without a shuffle: ``media`` is the stream (8-bit mono, one seek point
    per block), the other columns come from its decoded samples. Equal texts give equal values,
    repeated ids stay repeated, other columns are not looked at. Memory holds about two megabytes
    of texts, or the longest single text, at a time.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            for lo, hi in runs_of(at):
                payloads = [payload_of(data[at[i]:at[i + 1]], block) for i in range(lo, hi)]
                streams = flac.encode(payloads, block)
                read = flac.decode(streams)
                stored = [(s.view(np.uint8) ^ np.uint8(128)).tobytes() for s in read]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo).cast(pa.int64()),
                    pa.array(np.diff(at[lo:hi + 1])),
                    pa.array([len(p) for p in stored], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in stored]),
                    pa.array([zlib.crc32(p[-32:]) for p in stored], pa.int64()),
                    pa.array([len(s) for s in streams], pa.int64()),
                    pa.array([hashlib.sha256(s).hexdigest() for s in streams]),
                    pa.array([features(s) for s in read]),
                    pa.array(streams, pa.binary()),
                ], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(convert, SCHEMA)


def samples_of(stream: bytes, first: int, count: int) -> bytes:
    """``count`` stored bytes from sample ``first`` on, of which only the blocks that hold them are read, by their seek offsets."""
    total, block = flac.shape(stream)
    first, end = min(first, total), min(first + count, total)
    if first >= end:
        return b""
    low = first // block
    read = flac.decode([stream], [(low, -(-end // block) - low)])[0]
    return (read[first - low * block:end - low * block].view(np.uint8) ^ np.uint8(128)).tobytes()


def pcm_blocks(stored: DataFrame, at_once: int = 256) -> DataFrame:
    """PCM blocks of FLAC streams: one row per block of every row of ``stored`` (doc_id, media).

    Returns doc_id, block (from 0), first_sample (the block's offset) and pcm (its bytes, as they
    were stored). Blocks are found by their seek offsets and decoded ``at_once`` at a time, so a
    long stream is never held decoded; checksums of frames are verified. A null stream has no
    blocks; repeated rows stay repeated.
    """
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, stream in zip(batch.column(0).cast(pa.int64()).to_pylist(), batch.column(1).to_pylist()):
                total, size = flac.shape(stream) if stream is not None else (0, BLOCK)
                for low in range(0, total, at_once * size):
                    pcm = samples_of(stream, low, at_once * size)
                    cuts = range(0, len(pcm), size)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([doc_id] * len(cuts), pa.int64()), pa.array([(low + c) // size for c in cuts], pa.int64()), pa.array([low + c for c in cuts], pa.int64()),
                        pa.array([pcm[c:c + size] for c in cuts], pa.binary())], names=["doc_id", "block", "first_sample", "pcm"])

    return stored.select("doc_id", "media").mapInArrow(convert, "doc_id long, block long, first_sample long, pcm binary")
