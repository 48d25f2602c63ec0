"""SimHash near-duplicates through covering locality-sensitive hashing.

Fingerprints are 64 bits of majority votes over hashed word shingles.  For a
radius ``r`` every bit gets a non-zero vector of ``r + 1`` bits in turn, and
table ``v`` keeps the bits whose vector has an odd product with ``v``.  The
``r`` differing bits of a pair span at most ``r`` dimensions, so some ``v``
is orthogonal to all of them: in that table the pair has equal kept bits.
All ``2**(r+1) - 1`` tables together therefore miss no pair within the
radius.

Only distinct fingerprints enter the tables.  A bucket of more than
``BUCKET`` of them is covered once more over the bits its table ignores,
which bounds every bucket by a few thousand fingerprints; a bucket gives the
edges of its spanning stars, never its pairs.

Defined results: null and blank texts have fingerprint zero and link like
any other; rows with a null id take part and get their class id, which is
the smallest non-null id of the class (null if there is none); repeated rows
are copies of one another; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shingle_cover
from tidemark.llm._common import release, small, stored, text_of
from tidemark.llm.components import connected_components

BUCKET = 2048
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Space-joined runs of ``size`` words; fewer words are one run."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(size)), strict=False)]


def fingerprint(text: bytes, size: int, seed: int = 42) -> int:
    """Majority vote of the XXH64 of the shingles, as an unsigned integer."""
    runs = shingles(text.lower().split(), size)
    if not runs:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(x, seed) for x in runs), dtype="<u8", count=len(runs))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    votes = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * votes > len(runs), bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int, bits: list[int]) -> list[int]:
    """The kept bits of each table over the positions ``bits``.

    Where there are more vectors than bits, those of odd weight go first,
    spread by a multiplicative hash: every table then keeps about half of
    the bits.
    """
    n = (1 << (radius + 1)) - 1
    order = sorted(range(1, n + 1), key=lambda m: (m.bit_count() % 2 == 0, m * 0x9E3779B1 % (1 << 32)))
    vector = {b: order[k % n] for k, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() & 1) for v in range(1, n + 1)]


def with_fingerprints(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """``docs`` without its text but with ``fp`` (long, the same 64 bits)."""
    keep = [c for c in docs.columns if c not in (text_col, "fp")]
    source = docs.select(*keep, text_of(text_col).alias("_td_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in (s for b in batches for s in small(b)):
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t, size) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.int64())], names=[*keep, "fp"])

    return source.mapInArrow(run, docs.select(*keep).schema.add("fp", "long"))


def _stars(values: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Spanning stars of the graph that links values within the radius."""
    left = np.ones(len(values), dtype=bool)
    unsigned = values.view(np.uint64)
    src: list[int] = []
    dst: list[int] = []
    for root in range(len(values)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo and left.any():
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(unsigned[rest] ^ unsigned[todo.pop()]) <= radius]
            left[near] = False
            todo += near.tolist()
            src += values[near].tolist()
            dst += [int(values[root])] * len(near)
    return src, dst


def link_edges(distinct: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """Edges (``src``, ``dst`` fingerprints) that connect all pairs within the radius."""
    tables = covering_masks(radius, list(range(64)))
    second = [[_signed(m | x) for x in covering_masks(radius, [b for b in range(64) if not m >> b & 1])] for m in tables]
    masks = F.array(*(F.lit(_signed(m)) for m in tables))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Fingerprints are few bytes and become many rows: deal them out before that.
    rows = distinct.select("fp").repartition(parts).select("fp", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("t", "key"))
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(rows.join(sizes, ["t", "key"]), "buckets")

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for table in np.unique(t).tolist():
                own = fp[t == table]
                for u, mask in enumerate(second[table]):
                    number = pa.array(np.full(len(own), table, np.int32)), pa.array(np.full(len(own), u, np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(own), *number, pa.array(own & np.int64(mask))], names=["fp", "t", "u", "key"])

    hot = shared.where(F.col("n") > bucket).select("fp", "t").mapInArrow(finer, "fp long, t int, u int, key long")
    cold = shared.where(F.col("n") <= bucket).select("fp", "t", F.lit(-1).alias("u"), "key")
    groups = cold.unionByName(hot).groupBy("t", "u", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src: list[int] = []
            dst: list[int] = []
            for fps in batch.column(0):
                a, b = _stars(np.sort(fps.values.to_numpy()), radius)
                src += a
                dst += b
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return groups.mapInArrow(run, "src long, dst long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(id, ``fp`` long, ``component_id``), one row per row of ``docs``."""
    fps = stored(with_fingerprints(docs.select(F.col(id_col).alias("_td_id"), F.col(text_col).alias("_td_in")), "_td_in", size), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("_td_id").alias("rep")), "distinct-fps")
    found = connected_components(link_edges(distinct, radius, bucket))
    rooted = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = stored(rooted.join(smallest, "root").select("fp", "component_id"), "classes")
    return fps.join(named, "fp").select(F.col("_td_id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component of texts whose shingles are similar by 0.8 or more.

    No radius over 64 majority bits reaches that similarity, so the covering
    masks are laid over the shingle sets themselves; see ``shingle_cover``.
    """
    return shingle_cover.keep_one(docs, id_col, text_col, size)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: fingerprints and near-duplicate classes of the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = classes(docs, size=3, radius=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
