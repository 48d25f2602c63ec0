"""Byte-level BPE by corpus-level merge replay.

1. *Distinct chunks.*  Texts are runs of chunks that no piece (match of the
   pattern) crosses; every task names its distinct ones, and those that two or
   more tasks name are the corpus' shared chunks.
2. *Replay.*  Shared chunks are dealt out, and each is encoded once: all bytes
   of a part's distinct pieces lie in one linked sequence, and an inverted
   index leads from the token a pair of neighbours would merge into to the
   positions of such pairs.  Merges are replayed in rank order, each over all
   its positions at once, and only the two touched neighbours of a merge
   enter the index again.
3. *Back.*  The most widely shared ``SHARED`` chunks (of at most ``MOST_BYTES``
   each, so some tens of megabytes) are broadcast with their ids, and every
   text is put together from its chunks.  What is rarer is replayed in
   the block it occurs in, again from an index over the block's pieces.

Where a pattern is not the one whose chunks are known, texts are not cut.

Ids leave as little-endian uint32 in a binary column; ``unpack`` reads them.

Defined results: null or empty text has no ids and decodes to nothing; ids
are per row, so repeated rows, ties and null ids need no rule; columns named
as outputs are replaced, others kept; an empty table gives no rows; a text
may be as long as a row can be.
"""

from __future__ import annotations

import base64
import uuid
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._common import held, release, small, stored, text_of
from tidemark.llm.chunks import ChunkEncoder, distinct_chunks

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Chunks that are broadcast at most, and their bytes.
SHARED, MOST_BYTES = 1 << 18, 32
#: Chunks a task remembers to name each once.
SEEN = 400_000


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Ids of pieces under a table of ranks; a token's id is its rank.

    Pieces are replayed together.  ``sym``, ``nxt`` and ``prv`` hold all their
    symbols as linked lists, the inverted index leads from a pair (numbered
    in ``keys``) to positions.  A rank's positions are merged in one
    vectorised step; where they overlap, every second one from the left is.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.single = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs = sorted(
            (ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        )
        self.keys = np.array([k for k, _ in pairs], dtype=np.int64)
        self.rank_of = np.array([r for _, r in pairs], dtype=np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each pair, -1 for pairs that make no token."""
        want = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, at, -1)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        return [unpack(p).tolist() for p in self.packed(pieces)]

    def packed(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece, as the smallest rank first and leftmost rule gives them."""
        ranks = self.ranks
        out = [b"" if (r := ranks.get(p)) is None else r.to_bytes(4, "little") for p in pieces]
        work = [k for k, p in enumerate(pieces) if p and not out[k]]
        if not work:
            return out
        length = np.array([len(pieces[k]) for k in work])
        end = np.cumsum(length)
        sym = self.single[np.frombuffer(b"".join([pieces[k] for k in work]), dtype=np.uint8)]
        n = len(sym)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[end - 1], prv[end - length] = -1, -1
        word = np.repeat(np.arange(len(work), dtype=np.int32), length)
        index: dict[int, dict[int, list[np.ndarray]]] = {}
        heap: list[int] = []

        def post(left: np.ndarray, below: int = -1) -> np.ndarray | None:
            """Enter the pairs that start at ``left``; the positions of those that rank below ``below``."""
            pair = self._find(sym[left], sym[nxt[left]])
            found = pair >= 0
            pair, left = pair[found], left[found]
            if not len(pair):
                return None
            order = np.argsort(pair, kind="stable")
            pair, left = pair[order], left[order]
            cuts = np.flatnonzero(pair[1:] != pair[:-1]) + 1
            for part, number in zip(np.split(left, cuts) if len(cuts) else (left,), pair[np.concatenate(([0], cuts))].tolist(), strict=True):
                rank = int(self.rank_of[number])
                if rank not in index:
                    index[rank] = {}
                    heappush(heap, rank)
                index[rank].setdefault(number, []).append(part)
            lower = self.rank_of[pair] < below
            return left[lower] if lower.any() else None

        post(np.flatnonzero(nxt >= 0))
        again: set[int] = set()
        while heap:
            rank = heappop(heap)
            live = []
            for number, parts in index.pop(rank).items():
                p = np.concatenate(parts) if len(parts) > 1 else parts[0]
                key = int(self.keys[number])
                q = nxt[p]
                live.append(p[(sym[p] == key >> 32) & (q >= 0) & (sym[q] == key & 0xFFFFFFFF)])
            p = live[0] if len(live) == 1 else np.concatenate(live)
            if not len(p):
                continue
            if len(p) > 1:
                p = np.unique(p)
                meets = nxt[p[:-1]] == p[1:]
                if meets.any():
                    place = np.arange(len(p))
                    run = np.maximum.accumulate(np.where(np.concatenate(([True], ~meets)), place, 0))
                    p = p[(place - run) % 2 == 0]
            q = nxt[p]
            after = nxt[q]
            sym[p], sym[q] = rank, -1
            nxt[p], nxt[q] = after, -1
            some = after >= 0
            prv[after[some]] = p[some]
            before = prv[p]
            touched = np.concatenate((p[some], before[before >= 0]))
            if len(touched):
                lower = post(touched, rank)
                if lower is not None and len(p) > 1:
                    # A smaller rank came up in a word that merged twice: its order is settled alone.
                    twice = np.unique(word[lower])
                    of = word[p]
                    again.update(w for w in twice.tolist() if np.count_nonzero(of == w) > 1)
        flat = sym[sym >= 0].astype("<u4").tobytes()
        stop = (4 * np.cumsum(np.bincount(word[sym >= 0], minlength=len(work)))).tolist()
        start = 0
        for k, e in zip(work, stop, strict=True):
            out[k] = flat[start:e]
            start = e
        for w in again:
            out[work[w]] = array("I", self._alone(pieces[work[w]])).tobytes()
        return out

    def _alone(self, piece: bytes) -> list[int]:
        """One piece, merge by merge: a heap of (rank, place) over a linked list."""
        ids: list[int] = [int(self.single[b]) for b in piece]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(ids) and (r := self.ranks.get(self.tokens[ids[i]] + self.tokens[ids[j]])) is not None:
                heappush(heap, (r, i, ids[i], ids[j]))

        for i in range(len(ids) - 1):
            offer(i)
        while heap:
            r, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class BlockEncoder:
    """Packed ids of texts: shared chunks by table, the rest piece by piece through merge replay."""

    def __init__(self, path: str, pattern: str, shared: dict[bytes, bytes] | None = None) -> None:
        self.replay = MergeReplay(load_ranks(path))
        self.pattern = regex.compile(pattern)
        self.chunks = ChunkEncoder(self.encode_chunks, capacity=400_000, shared=shared, cut=_is_known(pattern))

    def encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        split = [self.pattern.findall(c.decode()) for c in chunks]
        pieces = list(set(chain.from_iterable(split)))
        packed = dict(zip(pieces, self.replay.packed([p.encode() for p in pieces]), strict=True))
        return [packed[s[0]] if len(s) == 1 else b"".join([packed[p] for p in s]) for s in split]


def _is_known(pattern: str) -> bool:
    import public_tokenizers

    return pattern == public_tokenizers.PATTERN


def _encoder(path: str, pattern: str, shared=None) -> BlockEncoder:
    table = shared.value if shared is not None else None
    return held(("bpe", path, pattern, shared.id if shared is not None else 0), lambda: BlockEncoder(path, pattern, table))


class _Shared:
    """A broadcast table and a name that tells it from others."""

    def __init__(self, broadcast, name: int) -> None:
        self.broadcast, self.id = broadcast, name

    @property
    def value(self) -> dict[bytes, bytes]:
        return self.broadcast.value


def shared_chunks(texts: DataFrame, path: str, pattern: str, most: int | None = None) -> _Shared | None:
    """Ids of the chunks that several tasks meet, each replayed once; ``texts`` has one column of text.

    The number of tasks that name a chunk ranks them.  At most ``most`` go out: the
    least rank that keeps within it is read from a count of chunks per rank.
    """
    if not _is_known(pattern):
        return None
    spark, most = texts.sparkSession, SHARED if most is None else most
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[bytes] = set()
        for batch in batches:
            for part in small(batch, 1000):
                new = distinct_chunks(part.column(0).cast(pa.binary()).to_pylist(), MOST_BYTES) - seen
                if len(seen) + len(new) > SEEN:
                    seen = set()
                seen |= new
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary())], names=["chunk"])

    named = texts.mapInArrow(name, "chunk binary").groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    named = stored(named, "chunks")
    total, least = 0, None
    # One row for each number of tasks.
    for row in named.groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("n")).toLocalIterator():
        total += row.c
        if total > most:
            break
        least = row.n
    if least is None:
        return None

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            ids = encoder.encode_chunks(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["chunk", "ids"])

    chosen = named.where(F.col("n") >= least).select("chunk").repartition(max(1, min(parts, total // 20_000 + 1)))
    table = chosen.mapInArrow(replay, "chunk binary, ids binary").toArrow()
    return _Shared(spark.sparkContext.broadcast(dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))), uuid.uuid4().int)


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype="<u4")


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, pattern: str | None = None, decoded: bool = False) -> DataFrame:
    """``docs`` without its text, with ``ids`` (packed) and ``n_tokens``, and with ``decoded`` the bytes the ids stand for."""
    import public_tokenizers

    path, pattern = path or default_path(), pattern or public_tokenizers.PATTERN
    added = ["ids", "n_tokens", *["decoded"] * decoded]
    keep = [c for c in docs.columns if c != text_col and c not in added]
    source = docs.select(*keep, text_of(text_col).alias("_td_text"))
    shared = shared_chunks(source.select("_td_text"), path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, pattern, shared)
        for batch in batches:
            for part in small(batch, 1000):
                packed = list(enc.chunks(part.column(part.num_columns - 1).cast(pa.binary()).to_pylist()))
                cols = [*part.columns[:-1], pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())]
                if decoded:
                    cols.append(pa.array([enc.replay.decode(unpack(p).tolist()) for p in packed], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *added])

    types = {"ids": T.BinaryType(), "n_tokens": T.LongType(), "decoded": T.BinaryType()}
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(a, types[a]) for a in added)])
    return source.mapInArrow(run, schema)


def decode(frame: DataFrame, ids_col: str = "ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """``frame`` with the bytes its packed ids stand for; null ids stay null."""
    import public_tokenizers

    path, pattern = path or default_path(), public_tokenizers.PATTERN
    keep = [c for c in frame.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = _encoder(path, pattern).replay
        for batch in batches:
            packed = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            found = pa.array([None if p is None else replay.decode(unpack(p).tolist()) for p in packed], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*keep, out])

    return frame.select(*keep).mapInArrow(run, T.StructType([*(frame.schema[c] for c in keep), T.StructField(out, T.BinaryType())]))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: ids and round trip of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
