"""Corpus-wide line deduplication through two Bloom filters.

One pass over the texts fills a *once* and a *twice* filter with line-key
hashes: a key met in a second document moves on to *twice*.  Tasks merge
their filters segment by segment (a bit set by two tasks counts as met
twice), so *twice* has no false negatives.  Only lines whose key hits
*twice* are shuffled, as whole keys pre-summed per batch; the exact counts
confirm which keys repeat and where each occurs first.

The filters have 16 bits a line up to a bound (see ``bloom``): above it more
lines are suspected and shuffled, the result stays exact.

Defined results: null or empty text is one empty line; empty keys never
repeat (``min_chars`` is at least 1); every row is a document of its own,
also if ids repeat; a null id comes after all others as first occurrence;
columns named as outputs are replaced, other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._common import WS, release, small, stored, text_of
from tidemark.llm.bloom import SEGMENT_SCHEMA, filter_bits, has_bits, merged, segments, set_bits

#: Confirmed keys up to this many bytes are broadcast; more are joined.
BROADCAST_BYTES = 32 << 20
_LAST = (1 << 63) - 1
_WS = WS.encode()


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z lower-cased."""
    return line.strip(_WS).lower()


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def _document_keys(text: bytes, min_chars: int) -> dict[bytes, int]:
    """The distinct keys of a document with the line each is first on."""
    out: dict[bytes, int] = {}
    for i, line in enumerate(text.split(b"\n")):
        key = line_key(line)
        if key and key not in out and (min_chars <= 1 or len(key.decode()) >= min_chars):
            out[key] = i
    return out


def twice_filter(docs: DataFrame, min_chars: int = 1) -> np.ndarray:
    """The merged *twice* filter over the one column ``_td_text`` of ``docs``."""
    spark = docs.sparkSession
    newlines = F.length("_td_text") - F.length(F.translate("_td_text", "\n", "")) + 1
    n_lines = docs.agg(F.coalesce(F.sum(newlines), F.lit(0))).first()[0]
    bits = filter_bits(n_lines)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in (s for b in batches for s in small(b)):
            keys = [k for t in _texts(batch, "_td_text") for k in _document_keys(t, min_chars)]
            found, counts = np.unique(_hashes(keys), return_counts=True)
            set_bits(twice, found[(counts > 1) | has_bits(once, found)])
            set_bits(once, found)
        yield from segments(once, twice)

    # A filter per task is shuffled, so as many tasks as there are cores, however many splits there are.
    tasks = docs.coalesce(2 * spark.sparkContext.defaultParallelism)
    return merged(tasks.mapInArrow(build, SEGMENT_SCHEMA), bits)


def repeated_keys(docs: DataFrame, filt, min_docs: int, min_chars: int) -> DataFrame:
    """Exact: key, documents, and the first (document, line) of each key in ``min_docs`` or more documents.

    ``docs``: ``_td_id`` (long, null last as the largest) and ``_td_text``.
    """

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(filt.value, np.uint8)
        for batch in batches:
            found: dict[bytes, list[int]] = {}
            for doc, text in zip(batch.column(0).to_pylist(), _texts(batch, "_td_text"), strict=True):
                keys = _document_keys(text, min_chars)
                hit = has_bits(twice, _hashes(list(keys)))
                for (key, line), ok in zip(keys.items(), hit, strict=True):
                    if ok:
                        old = found.get(key)
                        if old is None:
                            found[key] = [1, doc, line]
                        else:
                            old[0] += 1
                            if (doc, line) < (old[1], old[2]):
                                old[1], old[2] = doc, line
            n, doc, line = zip(*found.values(), strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(doc, pa.int64()), pa.array(line, pa.int64())],
                names=["key", "n", "doc", "line"],
            )

    rows = docs.select("_td_id", "_td_text").mapInArrow(suspects, "key string, n long, doc long, line long")
    return (
        rows.groupBy("key").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "line")).alias("first")).where(F.col("n") >= min_docs)
    ).select("key", "n", F.col("first.doc").alias("doc"), F.col("first.line").alias("line"))


def _clean(text: bytes, doc: int, drop: dict[bytes, tuple[int, int]], first: bool) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    kept = [x for i, x in enumerate(lines) if (at := drop.get(line_key(x))) is None or (first and at == (doc, i))]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    keep: str = "none",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` with repeated lines gone from the text, plus ``n_lines`` and ``n_dropped``.

    keep: ``none`` drops every line of a repeated key, ``first`` leaves its
    first occurrence (smallest id, then line).
    """
    if keep not in ("none", "first") or min_chars < 1 or min_docs < 2:
        raise ValueError("keep is none or first, min_chars at least 1, min_docs at least 2")
    spark = docs.sparkSession
    work = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("_td_id"), text_of(text_col).alias("_td_text"))
    filt = spark.sparkContext.broadcast(twice_filter(work.select("_td_text"), min_chars).tobytes())
    keys = stored(repeated_keys(work, filt, min_docs, min_chars), "line-keys")
    total = keys.agg(F.coalesce(F.sum(F.octet_length("key") + 100), F.lit(0))).first()[0]

    added = ("n_lines", "n_dropped")
    names = [n for n in docs.columns if n not in added]
    typed = T.StructType([*(docs.schema[n] for n in names), *(T.StructField(n, T.LongType()) for n in added)])
    own = [n for n in names if n != text_col]
    source = docs.select(*own, F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("_td_id"), text_of(text_col).alias("_td_text"))
    first = keep == "first"

    def rebuilt(batch: pa.RecordBatch, drops) -> pa.RecordBatch:
        ids = batch.column(batch.schema.get_field_index("_td_id")).to_pylist()
        done = [_clean(t, d, x, first) for t, d, x in zip(_texts(batch, "_td_text"), ids, drops, strict=True)]
        cols = [
            pa.array([x[0] for x in done], pa.binary()).cast(pa.string()) if n == text_col else batch.column(batch.schema.get_field_index(n))
            for n in names
        ]
        cols += [pa.array([x[k] for x in done], pa.int64()) for k in (1, 2)]
        return pa.RecordBatch.from_arrays(cols, names=[*names, *added])

    if total <= broadcast_bytes:
        drop = spark.sparkContext.broadcast({r.key.encode(): (r.doc, r.line) for r in keys.toLocalIterator()})

        def by_broadcast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (s for b in batches for s in small(b)):
                yield rebuilt(batch, [drop.value] * batch.num_rows)

        return source.mapInArrow(by_broadcast, typed)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(filt.value, np.uint8)
        for batch in (s for b in batches for s in small(b)):
            rows = []
            for doc, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch, "_td_text"), strict=True):
                own = list(_document_keys(text, min_chars))
                rows += [(doc, h, k) for k, ok in zip(own, has_bits(twice, _hashes(own)), strict=True) if ok]
            doc, h, key = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(h, pa.int64()), pa.array(key, pa.binary()).cast(pa.string())], names=["_td_id", "_td_h", "key"]
            )

    # Rows with one id and one text have one answer, so the pair is identity enough.
    source = source.withColumn("_td_h", F.xxhash64("_td_text"))
    met = source.select("_td_id", "_td_h", "_td_text").mapInArrow(lines, "_td_id long, _td_h long, key string")
    per_doc = met.join(keys, "key").groupBy("_td_id", "_td_h").agg(F.collect_set(F.struct("key", "doc", "line")).alias("_td_drop"))
    joined = source.join(per_doc, ["_td_id", "_td_h"], "left").select(*own, "_td_id", "_td_text", "_td_drop")

    def by_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in small(b)):
            found = batch.column(batch.schema.get_field_index("_td_drop")).to_pylist()
            yield rebuilt(batch, [{x["key"].encode(): (x["doc"], x["line"]) for x in f or ()} for f in found])

    return joined.mapInArrow(by_join, typed)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: lines in 10 or more documents leave the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_repeated_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, line, i,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE f.k IS NOT NULL)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k
GROUP BY doc_id
"""
