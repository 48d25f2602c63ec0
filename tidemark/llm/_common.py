"""Shared plumbing: shared-storage tables, word boundaries, row identity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import work_path

#: The white space of every word and line contract: U+0020 and U+0009-U+000D.
WS = " \t\n\x0b\x0c\r"
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    return work_path(spark, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    Cuts the lineage with files that survive the loss of any executor, so no
    later stage recomputes the work that made ``df``.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], Any]) -> Any:
    """A large helper that a Python worker keeps from task to task; the next kind of work takes its place."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Workers are used again by later stages: let go of what an earlier one has kept."""
    _held.clear()


def small(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that Python objects are made for a few rows at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def text_of(column: str) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as an array; empty for blank text."""
    bare = F.btrim(text, F.lit(WS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_SPLIT))


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (start, end) of the words of UTF-8 ``data``, vectorised."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[np.frombuffer(data, dtype=np.uint8)]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


class PolyHash:
    """64-bit hashes of many slices of one buffer from prefix sums.

    Bytes (or words) are mapped to random 64-bit values ``v`` and slice
    ``[s, e)`` hashes to ``sum(v[j] * B**(j - s))`` modulo 2**64, then through
    a finaliser.  Two seeds give two independent functions.
    """

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.base = np.uint64(int(rng.integers(1 << 62)) * 4 + 5 & (1 << 64) - 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.table = rng.integers(0, 1 << 64, size=256, dtype=np.uint64)
        self._grow(1024)

    def _grow(self, n: int) -> None:
        self.up = np.ones(n, dtype=np.uint64)
        self.down = np.ones(n, dtype=np.uint64)
        self.up[1:] = self.base
        self.down[1:] = self.inverse
        np.multiply.accumulate(self.up, out=self.up)
        np.multiply.accumulate(self.down, out=self.down)

    def slices(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(values) >= len(self.up):
            self._grow(2 * len(values) + 2)
        prefix = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.up[: len(values)], out=prefix[1:])
        return mix64((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64))

    def words(self, data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.slices(self.table[np.frombuffer(data, dtype=np.uint8)], start, end)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PAD = 16
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _step(seed: int) -> np.uint64:
    return np.uint64(int(mix64(np.array([seed], np.uint64))[0]) | 1)


def word_hashes(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, number of words of each text) of UTF-8 texts.

    Up to 16 bytes of a word enter two bijective mixers whole; longer words
    go through XXH3.  Nothing here is linear in the bytes, so no pattern of
    words collides by its structure.
    """
    data = b" " * _PAD + b" ".join(texts) + b" " * _PAD
    start, end = word_bounds(data)
    size = end - start
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    low = eight[start] & _LOW[np.minimum(size, 8)]
    high = eight[start + 8] & _LOW[np.clip(size - 8, 0, 8)]
    out = mix64(low ^ mix64(high + size.astype(np.uint64) * _step(2 * seed + 1)) + _step(2 * seed + 2))
    for k in np.flatnonzero(size > 16).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]], seed)
    stop = _PAD - 1 + np.cumsum(np.array([len(t) for t in texts], dtype=np.int64) + 1)
    upto = np.searchsorted(start, stop)
    return out, np.diff(upto, prepend=0)


def run_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of ``size`` word hashes, by doubling: every step mixes, so order and place count."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    out, at, length, part = None, 0, 1, words
    while True:
        if size & length:
            out = part[at : at + n] if out is None else mix64(out * _step(seed + 77) + part[at : at + n])
            at += length
        if 2 * length > size:
            return out
        part = mix64(part[:-length] * _step(seed + length) + part[length:])
        length *= 2
