"""Texts as runs of chunks that a byte-level pattern never joins.

The pattern of byte-level BPE lets a piece hold a space only as its first
character or within a run of white space.  A single space between two other
characters therefore always starts a piece, and a single newline between two
other characters is a piece.  So texts are cut there, every distinct chunk is
encoded once, and a text's ids are the concatenation of its chunks' ids.

A block of texts is cut, hashed and put together again by numpy; Python sees
its distinct chunks only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import xxhash

from tidemark.llm._common import mix64

_PAD = 16
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: Lies between texts; as it is blank, nothing is cut next to it.
_BETWEEN = b"\x1c"


def _blank3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether three bytes are a white space character beyond U+07FF."""
    e2 = (a == 0xE2) & (((b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    return e2 | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))


def cuts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the single spaces and of the single newlines in padded bytes."""
    at = np.flatnonzero((raw == 0x20) | (raw == 0x0A))
    before, after = raw[at - 1], raw[at + 1]
    blank = _BLANK[before] | _BLANK[after]
    # Characters of more bytes: few positions have one that could be white space.
    wide = np.flatnonzero(~blank & ((before >= 0x80) | (after >= 0xC2)))
    if len(wide):
        p = at[wide]
        b1, b2, b3, a1, a2, a3 = (raw[p + k] for k in (-1, -2, -3, 1, 2, 3))
        two = ((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))) | ((a1 == 0xC2) & ((a2 == 0x85) | (a2 == 0xA0)))
        blank[wide] = two | _blank3(b3, b2, b1) | _blank3(a1, a2, a3)
    at = at[~blank]
    newline = raw[at] == 0x0A
    return at[~newline], at[newline]


def alike(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each kind, kind) of slices of padded ``data``.

    Up to 16 bytes are told apart by themselves, in two numbers, longer
    slices by 128 bits of hash.
    """
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    size = end - start
    low = eight[start] & _MASK[np.minimum(size, 8)]
    high = eight[start + 8] & _MASK[np.clip(size - 8, 0, 8)]
    for k in np.flatnonzero(size > 16).tolist():
        digest = xxhash.xxh3_128_intdigest(data[start[k] : end[k]])
        low[k], high[k] = digest & 0xFFFFFFFFFFFFFFFF, digest >> 64
    key = mix64(low ^ mix64(high + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, one, which = np.unique(key, return_index=True, return_inverse=True)
    if ((low != low[one][which]) | (high != high[one][which]) | (size != size[one][which])).any():
        rows = np.stack((low, high, size.astype(np.uint64)), axis=1)
        _, one, which = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return one, which.ravel()


class ChunkEncoder:
    """Packed ids (little-endian uint32) of UTF-8 texts through a memo of chunks.

    encode: packed ids of each of a list of chunks.  The memo starts from
    ``shared`` and goes back to it beyond ``capacity`` more; that costs time,
    never changes a result.  Without ``cut`` a text is one chunk.
    """

    def __init__(
        self, encode: Callable[[list[bytes]], list[bytes]], capacity: int = 800_000, block_bytes: int = 1 << 21, shared: dict[bytes, bytes] | None = None, cut: bool = True
    ) -> None:
        self.encode, self.block_bytes, self.shared, self.cut = encode, block_bytes, shared or {}, cut
        self.capacity = capacity + len(self.shared)
        self.memo: dict[bytes, bytes] = dict(self.shared)

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        block: list[bytes] = []
        size = 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= self.block_bytes:
                yield from self._block(block)
                block, size = [], 0
        if block:
            yield from self._block(block)

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        memo = self.memo
        found = list(map(memo.get, chunks))
        missing = [k for k, x in enumerate(found) if x is None]
        if missing:
            if len(memo) > self.capacity:
                memo = self.memo = dict(self.shared)
            new = [chunks[k] for k in missing]
            packed = self.encode(new)
            memo.update(zip(new, packed, strict=True))
            for k, x in zip(missing, packed, strict=True):
                found[k] = x
        return found

    def _block(self, texts: list[bytes]) -> list[bytes]:
        if not self.cut:
            return self.encode(texts)
        data, start, end, owner = _slices(texts)
        if not len(start):
            return [b""] * len(texts)
        one, which = alike(data, start, end)
        found = self._ids([data[s:e] for s, e in zip(start[one].tolist(), end[one].tolist(), strict=True)])
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        count = np.array([len(x) // 4 for x in found], dtype=np.int64)
        offset = np.cumsum(count) - count
        n = count[which]
        stop = np.cumsum(n)
        picked = np.repeat(offset[which] - (stop - n), n) + np.arange(n.sum())
        ids = flat[picked].tobytes()
        total = np.cumsum(np.bincount(owner, weights=n, minlength=len(texts))).astype(np.int64).tolist()
        return [ids[4 * s : 4 * e] for s, e in zip([0, *total[:-1]], total, strict=True)]


def _slices(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(padded bytes, starts, ends, owners) of the chunks of texts, in order."""
    data = _BETWEEN * _PAD + _BETWEEN.join(texts) + _BETWEEN * _PAD
    raw = np.frombuffer(data, dtype=np.uint8)
    length = np.array([len(t) for t in texts], dtype=np.int64)
    last = _PAD - 1 + np.cumsum(length + 1)
    first = last - length
    spaces, newlines = cuts(raw)
    start = np.concatenate((first[length > 0], spaces, newlines, newlines + 1))
    start.sort()
    owner = np.searchsorted(last, start)
    end = np.append(start[1:], 0)
    if len(start):
        tail = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
        end[tail] = last[owner[tail]]
    return data, start, end, owner


def distinct_chunks(texts: list[bytes], most_bytes: int) -> set[bytes]:
    """The distinct chunks of texts that are no longer than ``most_bytes``."""
    data, start, end, _ = _slices(texts)
    short = end - start <= most_bytes
    start, end = start[short], end[short]
    if not len(start):
        return set()
    one, _ = alike(data, start, end)
    return {data[s:e] for s, e in zip(start[one].tolist(), end[one].tolist(), strict=True)}
