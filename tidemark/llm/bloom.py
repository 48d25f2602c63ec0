"""Bloom filters built by tasks and merged segment by segment.

A filter has 16 bits a key, at most ``MAX_BITS`` (32 MB); that bound is what
may reach the driver and be broadcast.  A fuller filter lets more keys
through, which costs work and never a result, as users check exactly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BITS = 1 << 28
BITS_PER_KEY = 16
SEGMENT = 1 << 16
SEGMENT_SCHEMA = "seg int, once binary, twice binary"


def filter_bits(n_keys: int) -> int:
    return min(MAX_BITS, max(8 * SEGMENT, 1 << int(BITS_PER_KEY * max(1, n_keys) - 1).bit_length()))


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    mask = np.uint64(bits - 1)
    return np.stack([hashes & mask, (hashes >> np.uint64(32)) & mask]).astype(np.int64)


def set_bits(filt: np.ndarray, hashes: np.ndarray) -> None:
    at = np.unique(_positions(hashes, len(filt) * 8))
    if len(at):
        byte = at >> 3
        first = np.flatnonzero(np.diff(byte, prepend=-1))
        filt[byte[first]] |= np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), first)


def has_bits(filt: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _positions(hashes, len(filt) * 8)
    return ((filt[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def segments(once: np.ndarray, twice: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's two filters as rows of ``SEGMENT_SCHEMA``."""
    for i in range(len(once) // SEGMENT):
        part = slice(i * SEGMENT, (i + 1) * SEGMENT)
        packed = [pa.array([zlib.compress(f[part], 1)], pa.binary()) for f in (once, twice)]
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *packed], names=["seg", "once", "twice"])


def merged(parts: DataFrame, bits: int) -> np.ndarray:
    """The *twice* filter of all tasks: set in a task's *twice*, or in two tasks' *once*."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                new = [np.frombuffer(zlib.decompress(row[k]), np.uint8) for k in ("once", "twice")]
                old = acc.setdefault(row["seg"], [np.zeros(SEGMENT, np.uint8), np.zeros(SEGMENT, np.uint8)])
                old[1] |= new[1] | (old[0] & new[0])
                old[0] |= new[0]
        for seg, (_, twice) in acc.items():
            yield pa.RecordBatch.from_pydict({"seg": pa.array([seg], pa.int32()), "twice": pa.array([zlib.compress(twice, 1)], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    for row in parts.repartition(F.col("seg")).mapInArrow(merge, "seg int, twice binary").toLocalIterator():
        out[row.seg * SEGMENT : (row.seg + 1) * SEGMENT] = np.frombuffer(zlib.decompress(row.twice), np.uint8)
    return out


def filter_of(keys: DataFrame, n_keys: int) -> np.ndarray:
    """The filter of the one long column of ``keys``."""
    bits = filter_bits(n_keys)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            set_bits(found, batch.column(0).to_numpy().view(np.uint64))
        yield from segments(np.zeros_like(found), found)

    tasks = keys.coalesce(2 * keys.sparkSession.sparkContext.defaultParallelism)
    return merged(tasks.mapInArrow(build, SEGMENT_SCHEMA), bits)
