"""Token ids in seekable zstandard files.

A file is a run of independent zstandard frames in ascending document
order.  No frame holds ids of two documents; a long document takes several.
Then come two skippable frames: the document index (ids, token counts, first
frames) and, last, the seek table of the zstandard seekable format with the
sizes and a checksum of every frame.  A reader fetches the tail, then only
the frames of the documents it wants.

Documents are range-partitioned by id and each partition writes one file
under a temporary name that is moved into place, so a task may run again on
another executor.  Files lie in the shared folder, in any store pyarrow's
filesystems can open.

Defined results: null or empty text has the end id only; null ids come
first; rows with equal ids follow each other ordered by a hash of their
text; an empty table gives files without frames; other columns play no part.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._common import held, scratch, small, stored, text_of
from tidemark.llm.chunks import ChunkEncoder

VOCABULARY = "byte_bpe_50k.json"
#: Fixed values of the zstandard seekable format and of our index frame.
SEEK_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
INDEX_MAGIC = 0x184D2A50
CHECKSUMS = 0x80
FRAME_IDS = 1 << 18
NULL_ID = -(1 << 63)
#: Letters below this code point, and marks, on which all Unicode versions agree.
LATIN_END, MARKS = "\u0250", ",.;:!?"


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _checksum(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class Writer:
    """Appends documents to one file; ``close`` writes index and seek table."""

    def __init__(self, sink, level: int = 3) -> None:
        self.sink, self.zstd = sink, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, packed: bytes) -> None:
        self.docs.append((NULL_ID if doc_id is None else doc_id, len(packed) // 4, len(self.frames)))
        for at in range(0, len(packed), 4 * FRAME_IDS):
            raw = packed[at : at + 4 * FRAME_IDS]
            frame = self.zstd.compress(raw)
            self.sink.write(frame)
            self.frames.append((len(frame), len(raw), _checksum(raw)))

    def close(self) -> None:
        index = zlib.compress(np.array(self.docs, dtype="<i8").tobytes(), 3)
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.frames.append((8 + len(index), 0, 0))
        entries = np.array(self.frames, dtype="<u4").tobytes()
        footer = struct.pack("<IBI", len(self.frames), CHECKSUMS, FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(entries) + len(footer)) + entries + footer)


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, source) -> None:
        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or flags != CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        body = self._at(size - 9 - 12 * n, 12 * n)
        frames = np.frombuffer(body, dtype="<u4").reshape(-1, 3).astype(np.int64)
        self.frames, self.offsets = frames[:-1], np.concatenate(([0], np.cumsum(frames[:, 0])))
        index = self._at(int(self.offsets[-2]) + 8, int(frames[-1, 0]) - 8)
        docs = np.frombuffer(zlib.decompress(index), dtype="<i8").reshape(-1, 3)
        self.ids, self.counts, self.first = docs[:, 0], docs[:, 1], docs[:, 2]
        self.last = np.concatenate((self.first[1:], [len(self.frames)])).astype(np.int64)

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def document(self, k: int) -> bytes:
        """Packed ids of the k-th document of the file."""
        out = []
        for f in range(int(self.first[k]), int(self.last[k])):
            size, raw_size, check = self.frames[f]
            raw = self.zstd.decompress(self._at(int(self.offsets[f]), int(size)), max_output_size=int(raw_size))
            if _checksum(raw) != check:
                raise ValueError(f"frame {f} is damaged")
            out.append(raw)
        return b"".join(out)

    def find(self, doc_id: int) -> bytes:
        """Packed ids of the first document with an id (files are sorted)."""
        k = int(np.searchsorted(self.ids, doc_id))
        if k == len(self.ids) or self.ids[k] != doc_id:
            raise KeyError(doc_id)
        return self.document(k)


def _byte_characters() -> dict[int, str]:
    """The character byte-level vocabularies write for each byte: itself if printable, else the next from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return {b: chr(b) if b in own else chr(next(spare)) for b in range(256)}


class LibraryEncoder:
    """Packed ids by the tokenizers library, each distinct chunk once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.newline = self._ids("\n")
        if len(self.newline) != 1:
            raise ValueError("the vocabulary has no newline token")
        self.mapped = _byte_characters()
        self.marks = {m: self._piece(m) for m in MARKS}
        self.chunks = ChunkEncoder(self._encode)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _piece(self, text: str) -> bytes:
        """Ids of a text that is one piece, from the library's model itself."""
        mapped = text.encode().decode("latin-1").translate(self.mapped)
        return array("I", [t.id for t in self.library.model.tokenize(mapped)]).tobytes()

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks.

        A chunk of Latin letters is one piece, and so is a mark behind it.
        Other chunks go to the library many at a time: a newline between two
        chunks without other white space is a piece of its own, so the lines
        can be told apart again in the ids.
        """
        out = [b""] * len(chunks)
        plain: list[tuple[int, str]] = []
        for k, chunk in enumerate(chunks):
            text = chunk.decode()
            word = text[1:] if text[0] == " " else text
            mark = word[-1:] if word[-1:] in MARKS else ""
            body = word[:-1] if mark else word
            if body.isalpha() and max(body) < LATIN_END:
                out[k] = self._piece(text[:-1]) + self.marks[mark] if mark else self._piece(text)
            elif word and not any(map(str.isspace, word)):
                plain.append((k, text))
            else:
                out[k] = self._ids(text).tobytes()
        for at in range(0, len(plain), 2000):
            part = plain[at : at + 2000]
            ids = self._ids("\n".join([t for _, t in part]))
            ends = np.append(np.flatnonzero(ids == self.newline[0]), len(ids)).tolist()
            raw, start = ids.tobytes(), 0
            for (k, _), end in zip(part, ends, strict=True):
                out[k] = raw[4 * start : 4 * end]
                start = end + 1
        return out

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """A text with the string of a special token in it is not cut."""
        whole = {k for k, t in enumerate(texts) if any(s in t for s in self.special)}
        out = iter(list(self.chunks([t for k, t in enumerate(texts) if k not in whole])))
        return [self._ids(t.decode()).tobytes() if k in whole else next(out) for k, t in enumerate(texts)]


def _library(path: str) -> LibraryEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return held(("library", path), lambda: LibraryEncoder(path))


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 0, files: int | None = None) -> DataFrame:
    """Write the ids of ``docs``; (``part``, ``file``, ``n_docs``, ``n_tokens``, ``bytes``) of each file."""
    path = path or default_path()
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(files, "id", "h").sortWithinPartitions("id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.zst"
        draft = f"{base}/.{name}.{task.taskAttemptId()}"
        end = struct.pack("<I", end_id)
        encode = _library(path)
        with store.open_output_stream(draft, compression=None) as sink:
            writer = Writer(sink)
            for batch in batches:
                for part in small(batch, 1000):
                    for doc, packed in zip(part.column(0).to_pylist(), encode(part.column(1).cast(pa.binary()).to_pylist()), strict=True):
                        writer.add(doc, packed + end)
            writer.close()
            size = sink.tell()
        store.move(draft, f"{base}/{name}")
        tokens = sum(d[1] for d in writer.docs)
        yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "file": name, "n_docs": len(writer.docs), "n_tokens": tokens, "bytes": size}])

    return stored(rows.mapInArrow(run, "part long, file string, n_docs long, n_tokens long, bytes long"), "token-files")


def read(spark: SparkSession, files: DataFrame, folder: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(id, ``start``, ``n_tokens``, ``ids_crc32`` and, if wanted, packed ``ids``) of every document from the files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = files.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{base}/{row['file']}") as source:
                    reader = Reader(source)
                    start = row["start"] + np.concatenate(([0], np.cumsum(reader.counts)))
                    for at in range(0, len(reader.ids), 500):
                        span = range(at, min(at + 500, len(reader.ids)))
                        packed = [reader.document(k) for k in span]
                        ids = [None if reader.ids[k] == NULL_ID else int(reader.ids[k]) for k in span]
                        cols = [pa.array(ids, pa.int64()), pa.array(start[span.start : span.stop], pa.int64())]
                        cols += [pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([zlib.crc32(p) for p in packed], pa.int64())]
                        cols += [pa.array(packed, pa.binary())] * with_ids
                        yield pa.RecordBatch.from_arrays(cols, names=[id_col, "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return starts.repartition(n).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: token files of the whole ``documents`` table, read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = scratch(spark, "tokens")
    return read(spark, write(docs, folder), folder, with_ids=False)
