"""Substring deduplication by relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller id.  It is cut
into blocks of bounded size, and a document is parsed against every block
that shares a seed with it:

1. *Seeds.*  Each window of ``length`` words names the smallest hash of the
   8-word runs in it.  Equal windows name equal seeds, and only some twentieth
   of all runs is ever named.  Seeds of one document alone are left out.
2. *Units.*  A run of windows that name one seed, with its words, is a unit:
   equal windows lie in units of one seed.  Equal units are one phrase of the
   reference.  Where all units of a seed are equal, the phrase is a factor of
   every later document that holds it.
3. *Reference blocks.*  The other phrases are dealt to blocks by seed.  A block
   is indexed by prefix doubling over its words, as a suffix array is built,
   up to ``length`` words: equal ranks are equal words, not equal hashes.  Its
   phrases are then factored greedily against the earliest place that holds
   each window, and a factor goes on as long as phrase and place do.
   The window across a factor's end is looked up like any other, so that
   no match is lost between two factors.
4. *Hot seeds.*  A seed of more than ``HOT`` phrases (around a passage that very
   many documents embed) would not fit one block: its windows are dealt out
   one by one, by 128 bits of XXH3 of their words, combined before the shuffle.
5. *Factors* of all blocks are put together by document.

Phrases and hot windows are told apart by 128 bits of XXH3 over their words.

Defined results: null and blank texts have no words; a null id counts as
larger than all others (two null ids are not smaller than each other);
rows that repeat an id are one document to each other, so neither removes
from the other; of equal passages the one with the smallest id stays; an empty
table gives no rows; the columns ``n_words``, ``n_removed`` and ``factors`` are
replaced, others kept; a text may be as long as a row can be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._common import release, run_hashes, small, stored, text_of, word_hashes

SEED_WORDS = 8
#: Phrases of one seed that a block takes.
HOT = 2048
#: Bytes of phrases in a block, on average.
BLOCK_BYTES = 4 << 20
_LAST = (1 << 63) - 1
FACTORS = "array<struct<start:int,n:int,source:long>>"
_FACTOR = pa.struct([("start", pa.int32()), ("n", pa.int32()), ("source", pa.int64())])
_PHRASE = ["seed", "hi", "lo"]


def window_seeds(words: np.ndarray, length: int) -> np.ndarray:
    """For each window start the smallest hash of a short run in it."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    low = run_hashes(words, min(SEED_WORDS, length), seed=5)
    span, n = length - min(SEED_WORDS, length) + 1, len(words) - length + 1
    size = 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[:n], low[span - size :][:n])


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column(batch.schema.get_field_index("_td_text")).cast(pa.binary()).to_pylist()


def _text_seeds(texts: list[bytes], length: int) -> Iterator[np.ndarray]:
    words, counts = word_hashes(texts, seed=3)
    at = 0
    for n in counts.tolist():
        yield window_seeds(words[at : at + n], length)
        at += n


def _digest(data: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(data)
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _seed_rows(work: DataFrame, length: int) -> DataFrame:
    """(``seed``, ``doc``, ``h``): the distinct seeds of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in (s for b in batches for s in small(b)):
            found = [np.unique(s) for s in _text_seeds(_texts(batch), length)]
            n = [len(f) for f in found]
            own = [pa.array(np.repeat(batch.column(k).to_numpy(), n), pa.int64()) for k in (0, 1)]
            yield _batch({"seed": pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)), "doc": own[0], "h": own[1]})

    return work.select("_td_id", "_td_h", "_td_text").mapInArrow(run, "seed long, doc long, h long")


def _units(shared: DataFrame, length: int) -> DataFrame:
    """Units of the seeds in ``_td_seeds``: place, number of windows, digest and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in small(b, 100)):
            texts, wanted = _texts(batch), batch.column(batch.schema.get_field_index("_td_seeds"))
            rows: list[tuple] = []
            for doc, h, text, seeds, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, _text_seeds(texts, length), wanted, strict=True):
                first = np.flatnonzero(np.concatenate((np.ones(min(1, len(seeds)), bool), seeds[1:] != seeds[:-1])))
                n = np.diff(np.append(first, len(seeds)))
                hit = np.isin(seeds[first].view(np.int64), known.values.to_numpy())
                words = text.split()
                for at, k, s in zip(first[hit].tolist(), n[hit].tolist(), seeds[first[hit]].view(np.int64).tolist(), strict=True):
                    phrase = b" ".join(words[at : at + k + length - 1])
                    rows.append((s, *_digest(phrase), doc, h, at, k, phrase))
            cols = zip(*rows, strict=True) if rows else [()] * 8
            kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()]
            yield _batch({n: pa.array(c, k) for n, c, k in zip([*_PHRASE, "doc", "h", "at", "n", "phrase"], cols, kinds, strict=True)})

    schema = "seed long, hi long, lo long, doc long, h long, at int, n int, phrase binary"
    return shared.select("_td_id", "_td_h", "_td_text", "_td_seeds").mapInArrow(run, schema)


def window_ranks(words: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the ``length`` words from each place on, by prefix doubling: equal ranks, equal words."""

    def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1] if len(a) else a

    n = len(words) - length + 1
    out, at, size, part = None, 0, 1, words
    while True:
        if length & size:
            out = part[at : at + n] if out is None else paired(out, part[at : at + n])
            at += size
        if 2 * size > length:
            return out
        part = paired(part[:-size], part[size:])
        size *= 2


def block_factors(phrases: list[bytes], docs: list[int], length: int) -> list[list[tuple[int, int, int]]]:
    """Greedy factors (start, windows, source) of each phrase; ``docs`` holds the first document of each, ascending."""
    number: dict[bytes, int] = {}
    ids: list[int] = []
    sizes = []
    for k, phrase in enumerate(phrases):
        words = phrase.split(b" ")
        sizes.append(len(words))
        ids += [number.setdefault(w, len(number)) for w in words]
    size = np.array(sizes)
    start = np.cumsum(size) - size
    rank = window_ranks(np.array(ids, dtype=np.int64), length)
    owner = np.repeat(np.arange(len(size)), size)[: len(rank)]
    inside = np.flatnonzero(np.arange(len(rank)) + length <= (start + size)[owner])
    # The earliest place of each window; places stand in the order of documents.
    _, first, which = np.unique(rank[inside], return_index=True, return_inverse=True)
    place = inside[first][which]
    new = (np.diff(place) != 1) | (np.diff(inside) != 1) | (np.diff(owner[inside]) != 0) | (np.diff(owner[place]) != 0)
    cut = np.concatenate(([True], new))
    begin = np.flatnonzero(cut)
    n = np.diff(np.append(begin, len(inside)))
    out: list[list[tuple[int, int, int]]] = [[] for _ in phrases]
    of = owner[inside[begin]]
    for k, at, m, p in zip(of.tolist(), (inside[begin] - start[of]).tolist(), n.tolist(), owner[place[begin]].tolist(), strict=True):
        out[k].append((at, m, docs[p]))
    return out


def _parsed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Factors of the phrases of each block; rows come sorted by block and document."""
    block, held = None, []

    def done() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        found = block_factors(rows.column("phrase").to_pylist(), rows.column("source").to_pylist(), length)
        lists = pa.array([[{"start": s, "n": n, "source": d} for s, n, d in f] for f in found], pa.list_(_FACTOR))
        return _batch({**{c: rows.column(c).combine_chunks() for c in _PHRASE}, "factors": lists})

    for batch in batches:
        of = batch.column(0).to_numpy()
        cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)], strict=True):
            if held and of[a] != block:
                yield done()
                held = []
            block = of[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield done()


def _phrase_factors(phrases: DataFrame, length: int) -> DataFrame:
    """(seed, hi, lo, ``factors``) of the distinct phrases (seed, hi, lo, ``source``, ``phrase``)."""
    parts = int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_seed = stored(phrases.groupBy("seed").agg(F.count(F.lit(1)).alias("c"), F.sum(F.octet_length("phrase")).alias("b")), "seed-sizes")
    fits = F.col("c") <= HOT
    total, n_hot = per_seed.agg(F.coalesce(F.sum(F.when(fits, F.col("b"))), F.lit(0)), F.count(F.when(~fits, 1))).first()
    blocks = max(parts, total // BLOCK_BYTES + 1)
    sized = phrases.join(per_seed.select("seed", "c"), "seed")

    cold = sized.where(F.col("c") <= HOT).select(F.pmod(F.xxhash64("seed"), F.lit(blocks)).alias("block"), *_PHRASE, "source", "phrase")
    cold = cold.repartition(parts, "block").sortWithinPartitions("block", "source", "hi", "lo")
    parsed = cold.mapInArrow(lambda batches: _parsed(batches, length), f"seed long, hi long, lo long, factors {FACTORS}")

    if not n_hot:
        return parsed

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in small(b)):
            rows = []
            for seed, hi, lo, source, phrase in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = phrase.split(b" ")
                for at in range(len(words) - length + 1):
                    rows.append((*_digest(b" ".join(words[at : at + length])), seed, hi, lo, at, source))
            cols = zip(*rows, strict=True) if rows else [()] * 7
            yield _batch({n: pa.array(c, pa.int64()) for n, c in zip(["w", "v", *_PHRASE, "at", "source"], cols, strict=True)})

    hot = sized.where(F.col("c") > HOT).select(*_PHRASE, "source", "phrase").mapInArrow(windows, "w long, v long, seed long, hi long, lo long, at long, source long")
    hot = stored(hot, "hot-windows")
    # Read from a table, the index has a shuffle of its own, and Spark may split what a frequent window joins.
    index = stored(hot.groupBy("w", "v").agg(F.min("source").alias("source")), "window-index")
    single = F.struct(F.col("at").cast("int").alias("start"), F.lit(1).alias("n"), index["source"])
    looked = hot.drop("source").join(index, ["w", "v"]).groupBy(*_PHRASE).agg(F.collect_list(single).cast(FACTORS).alias("factors"))
    return parsed.unionByName(looked)


def factor_table(work: DataFrame, length: int) -> DataFrame:
    """(``_td_id``, ``_td_h``, ``_td_found``: array of (start, n windows, source)) of documents with windows in smaller ones."""
    rows = stored(_seed_rows(work, length), "seeds")
    shared = rows.groupBy("seed").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("seed")
    named = rows.join(shared, "seed").groupBy(F.col("doc").alias("_td_id"), F.col("h").alias("_td_h")).agg(F.collect_set("seed").alias("_td_seeds"))
    units = stored(_units(work.join(named, ["_td_id", "_td_h"]), length), "units")

    range_of = [f(c).alias(f"{name}_{c}") for c in ("doc", "hi", "lo") for name, f in (("min", F.min), ("max", F.max))]
    kinds = units.groupBy("seed").agg(*range_of)
    kinds = stored(kinds.select("seed", F.col("min_doc").alias("source"), F.expr("min_hi = max_hi AND min_lo = max_lo").alias("alike")), "seed-kinds")
    place = F.col("doc").alias("_td_id"), F.col("h").alias("_td_h")
    whole = units.drop("phrase").join(kinds.where("alike"), "seed").where("doc > source")
    whole = whole.select(*place, F.struct(F.col("at").alias("start"), "n", "source").alias("x"))

    varied = units.join(kinds.where("NOT alike").select("seed"), "seed")
    phrases = stored(varied.groupBy(*_PHRASE).agg(F.min("doc").alias("source"), F.first("phrase").alias("phrase")), "phrases")
    found = stored(_phrase_factors(phrases, length), "phrase-factors")
    parts = units.drop("phrase").join(found, _PHRASE).select("doc", "h", "at", F.explode("factors").alias("f")).where("doc > f.source")
    parts = parts.select(*place, F.struct((F.col("at") + F.col("f.start")).alias("start"), F.col("f.n").alias("n"), F.col("f.source").alias("source")).alias("x"))
    return whole.unionByName(parts).groupBy("_td_id", "_td_h").agg(F.collect_set("x").alias("_td_found"))


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = [c for c in docs.columns if c != text_col]
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("_td_id")
    return docs.select(*own, ids, text_of(text_col).alias("_td_text")).withColumn("_td_h", F.xxhash64("_td_text"))


def parse(starts: np.ndarray, counts: np.ndarray, sources: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Greedy factors (start, words, source) from runs of windows found in smaller documents."""
    before = np.cumsum(counts) - counts
    starts = np.repeat(starts - before, counts) + np.arange(counts.sum())
    sources = np.repeat(sources, counts)
    starts, first = np.unique(starts, return_index=True)
    if not len(starts):
        return []
    sources = sources[first]
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(starts) > 1) | (np.diff(sources) != 0))))
    stop = np.append(cut[1:], len(starts)) - 1
    return [(int(starts[a]), int(starts[b] - starts[a]) + length, int(sources[a])) for a, b in zip(cut, stop, strict=True)]


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """``docs`` with the text reduced to its kept words, joined by one space.

    Added: ``n_words``, ``n_removed`` and ``factors``, the array of (start
    word, words, source id) whose words are gone.
    """
    added = {
        "n_words": T.LongType(),
        "n_removed": T.LongType(),
        "factors": T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "words", "source")])),
    }
    names = [n for n in docs.columns if n not in added]
    schema = T.StructType([*(docs.schema[n] for n in names), *(T.StructField(n, t) for n, t in added.items())])
    docs = docs.select(*names)
    work = _prepared(docs, id_col, text_col)
    joined = work.join(factor_table(work, length), ["_td_id", "_td_h"], "left").select(*(n for n in names if n != text_col), "_td_text", "_td_found")
    factor_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "words", "source")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[bytes] = []
            counts: list[tuple[int, int]] = []
            factors: list[list[dict]] = []
            for data, found in zip(_texts(batch), batch.column(batch.schema.get_field_index("_td_found")), strict=True):
                words = data.split()
                own = []
                keep = np.ones(len(words), dtype=bool)
                if found.is_valid:
                    x = found.values.flatten()
                    own = parse(*(c.to_numpy().astype(np.int64) for c in x), length)
                    for start, n, _ in own:
                        keep[start : start + n] = False
                texts.append(b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k]) if own else b" ".join(words))
                counts.append((len(words), len(words) - int(keep.sum())))
                factors.append([{"start": s, "words": n, "source": d} for s, n, d in own])
            cols = [
                pa.array(texts, pa.binary()).cast(pa.string()) if n == text_col else batch.column(batch.schema.get_field_index(n)) for n in names
            ]
            cols += [pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1)] + [pa.array(factors, factor_type)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *added])

    return joined.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: words of 50-word passages that start in a smaller document leave the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_repeated_passages(docs, length=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], chr(10))) AS k
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS a FROM w) WHERE a < doc_id),
g AS (SELECT doc_id, list(DISTINCT i + j) AS gone FROM f, (SELECT unnest(range(50)) AS j) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
