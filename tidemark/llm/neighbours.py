"""Approximate nearest neighbours by cross-polytope hashing.

Each table rotates a vector twice, by three rounds of random signs and a fast
Hadamard transform each, and hashes it to the pair of signed axes it is
nearest to: ``4 * dimensions ** 2`` buckets.  A query probes, in every table,
the pairs with the largest sums of coordinates.  Vectors and probing queries
meet by the first axis; within it only pairs of equal second axis are scored,
in double precision and in an order of summation that depends on nothing else.

The number of probes is fitted: for ``SAMPLE`` queries the true neighbours among
all rows give, for each table, the place of the neighbour's bucket in the
query's order of probes; ``probes`` is the least number that reaches ``TARGET``
of them.  Neighbours of larger tables are nearer, so they take fewer probes of
buckets that are a fixed share of the table.

Inner product is the measure.  Vectors of different norms get one more
coordinate that makes norms equal, which turns it into an angle.

Buckets are cut into chunks of bounded rows by their counts (one row for each
of ``tables * 2 * dimensions`` first axes, broadcast); queries stream past a
chunk.  Equal vectors in a chunk keep only their smallest ids, as no other can
be among the nearest.  A query that finds fewer than ``k`` though there are
more vectors looks at every bucket of one table, which is every vector.

Defined results: vectors that are null, zero, hold null or non-finite
components or have not the most frequent length take no part, as queries or
candidates; ties go to the smaller id; rows with a null id take no part; an
id that repeats counts once per row but is never its own neighbour; an empty
table gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import stored

TABLES, SEED = 14, 17
#: First axes a query probes at most, queries the number of probes is fitted on, and the share of neighbours to reach there.
FIRST_AXES, SAMPLE, TARGET = 12, 200, 0.93
CHUNK, PAIRS = 16384, 1 << 17
FOUND = "query_id long, vec_id long, score double"


def _power(n: int) -> int:
    return 1 << max(1, (n - 1).bit_length())


class Rotations:
    """Signed axes of unit vectors under the pseudo-rotations of each table, two a table."""

    def __init__(self, dims: int, tables: int, seed: int = SEED) -> None:
        self.size = _power(dims)
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), size=(2 * tables, 3, self.size))

    def both(self, x: np.ndarray, number: int) -> np.ndarray:
        """Coordinates on all signed axes (axis, + size if negative) under one rotation."""
        out = np.zeros((len(x), self.size), np.float32)
        out[:, : x.shape[1]] = x
        for signs in self.signs[number]:
            out *= signs
            half = 1
            while half < self.size:
                v = out.reshape(len(x), -1, 2, half)
                a, b = v[:, :, 0, :] + v[:, :, 1, :], v[:, :, 0, :] - v[:, :, 1, :]
                out = np.stack((a, b), axis=2).reshape(len(x), self.size)
                half *= 2
        return np.concatenate((out, -out), axis=1)

    def nearest(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        return self.both(x, 2 * table).argmax(axis=1), self.both(x, 2 * table + 1).argmax(axis=1)

    def probes(self, x: np.ndarray, table: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first axes, second axes) of the ``n`` best pairs of each vector, pairs of one first axis next to each other."""
        a, b = self.both(x, 2 * table), self.both(x, 2 * table + 1)
        first = np.argsort(-a, axis=1, kind="stable")[:, :FIRST_AXES]
        sums = (np.take_along_axis(a, first, axis=1)[:, :, None] + b[:, None, :]).reshape(len(x), -1)
        best = np.arange(sums.shape[1])[None, :] if n >= sums.shape[1] else np.sort(np.argpartition(-sums, n - 1, axis=1)[:, :n], axis=1)
        best = np.broadcast_to(best, (len(x), best.shape[1]))
        return np.take_along_axis(first, best // b.shape[1], axis=1), best % b.shape[1]

    def place(self, q: np.ndarray, x: np.ndarray, table: int) -> np.ndarray:
        """How many pairs come before the one of ``x`` in the order of probes of ``q``, row by row; more than all if it is not probed."""
        a, b = self.both(q, 2 * table), self.both(q, 2 * table + 1)
        i, j = self.nearest(x, table)
        rows = np.arange(len(q))
        top = -np.sort(-a, axis=1)[:, :FIRST_AXES]
        mine = a[rows, i] + b[rows, j]
        before = (top[:, :, None] + b[:, None, :] > mine[:, None, None]).sum(axis=(1, 2))
        return np.where(a[rows, i] >= top[:, -1], before, np.iinfo(np.int64).max)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _valid(vec: Column) -> Column:
    finite = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda x: x != 0)


class Space:
    """Vectors and queries as unit vectors whose angles order as the inner products do."""

    def __init__(self, dims: int, longest: float, lift: bool, tables: int, seed: int) -> None:
        self.dims, self.longest, self.lift, self.tables, self.seed = dims, longest, lift, tables, seed

    def rotations(self) -> Rotations:
        return Rotations(self.dims + self.lift, self.tables, self.seed)

    def index(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        return np.concatenate((x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))), axis=1) if self.lift else x

    def query(self, x: np.ndarray) -> np.ndarray:
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.concatenate((x, np.zeros((len(x), 1))), axis=1) if self.lift else x


def _indexed(vectors: DataFrame, space: Space, kind: str) -> DataFrame:
    """(``id``, ``vec``, ``bucket``: table and first axis, ``second``): one row for every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rot = space.rotations()
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                x = space.index(_matrix(batch.column(1), space.dims))
                for t in range(space.tables):
                    i, j = rot.nearest(x, t)
                    cols = [*batch.columns, pa.array((t * 2 * rot.size + i).astype(np.int32)), pa.array(j.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, names=["id", "vec", "bucket", "second"])

    return vectors.mapInArrow(run, f"id long, vec {kind}, bucket int, second int")


def _probing(queries: DataFrame, space: Space, kind: str, n: int) -> DataFrame:
    """(``id``, ``vec``, ``bucket``, ``seconds``): a query and the second axes it probes under a first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rot = space.rotations()
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                x = space.query(_matrix(batch.column(1), space.dims))
                for t in range(space.tables):
                    first, second = rot.probes(x, t, n)
                    per = first.shape[1]
                    row = np.repeat(np.arange(len(x)), per)
                    flat = first.ravel()
                    cut = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (flat[1:] != flat[:-1]))))
                    seconds = pa.ListArray.from_arrays(pa.array(np.append(cut, len(flat)).astype(np.int32)), pa.array(second.ravel().astype(np.int32)))
                    pick = pa.array(row[cut])
                    cols = [batch.column(0).take(pick), batch.column(1).take(pick), pa.array((t * 2 * rot.size + flat[cut]).astype(np.int32)), seconds]
                    yield pa.RecordBatch.from_arrays(cols, names=["id", "vec", "bucket", "seconds"])

    return queries.mapInArrow(run, f"id long, vec {kind}, bucket int, seconds array<int>")


def _distinct(ids: np.ndarray, x: np.ndarray, second: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal vectors the k + 1 smallest ids, sorted by second axis and id."""
    order = np.argsort(ids, kind="stable")
    ids, x, second = ids[order], np.ascontiguousarray(x[order]), second[order]
    rows = (x + 0.0).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, group = np.unique(rows, return_inverse=True)
    by = np.argsort(group, kind="stable")
    sorted_group = group[by]
    first = np.flatnonzero(np.concatenate(([True], sorted_group[1:] != sorted_group[:-1])))
    place = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
    keep = np.sort(by[place <= k])
    keep = keep[np.argsort(second[keep], kind="stable")]
    return ids[keep], x[keep], second[keep]


def _top(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the best k rows of each query, of repeated (query, vector) the first."""
    order = np.lexsort((vec, -score, query))
    q, v = query[order], vec[order]
    fresh = np.concatenate((np.ones(min(1, len(q)), bool), (q[1:] != q[:-1]) | (v[1:] != v[:-1])))
    order, q = order[fresh], q[fresh]
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(q)), bool), q[1:] != q[:-1])))
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[place < k]


class _Best:
    """The best k of each query seen by a task, handed on when many rows are held."""

    def __init__(self, k: int, most: int = 400_000) -> None:
        self.k, self.most, self.n = k, most, 0
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: np.ndarray, x: np.ndarray, second: np.ndarray, query_ids: np.ndarray, q: np.ndarray, seconds: pa.Array) -> Iterator[pa.RecordBatch]:
        """Score queries against a chunk sorted by second axis; an empty list of axes means all of them."""
        size = np.diff(seconds.offsets.to_numpy())
        axes = seconds.flatten().to_numpy()
        row = np.repeat(np.arange(len(q)), np.maximum(size, 1))
        low, high = np.zeros(len(row), np.int64), np.full(len(row), len(ids), np.int64)
        some = np.repeat(size > 0, np.maximum(size, 1))
        low[some], high[some] = np.searchsorted(second, axes, "left"), np.searchsorted(second, axes, "right")
        hit = high > low
        row, low, n = row[hit], low[hit], (high - low)[hit]
        upto = np.cumsum(n)
        at = 0
        while at < len(row):
            # A probe of a chunk has at most CHUNK rows, so a step is bounded.
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            span = n[at:end]
            left = np.repeat(row[at:end], span)
            right = np.arange(span.sum()) + np.repeat(low[at:end] - (np.cumsum(span) - span), span)
            other = query_ids[left] != ids[right]
            left, right = left[other], right[other]
            score = (q[left] * x[right]).sum(axis=1)
            best = _top(query_ids[left], ids[right], score, self.k)
            self.found.append((query_ids[left[best]], ids[right[best]], score[best]))
            self.n += len(best)
            at = end
            if self.n > self.most:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.found:
            q, v, s = (np.concatenate(c) for c in zip(*self.found, strict=True))
            best = _top(q, v, s, self.k)
            yield pa.RecordBatch.from_arrays([pa.array(q[best]), pa.array(v[best]), pa.array(s[best])], names=["query_id", "vec_id", "score"])
        self.found, self.n = [], 0


def _meet(index: DataFrame, probing: DataFrame, dims: int, k: int) -> DataFrame:
    """The best k a task finds for each query; index rows and probes meet by bucket and chunk."""
    counts = index.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    counts = F.broadcast(stored(counts, "bucket-chunks"))  # at most tables * 2 * dims rows
    none = F.array().cast("array<int>")
    left = index.join(counts, "bucket").select("id", "vec", "bucket", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"), F.lit(0).alias("kind"), "second", none.alias("seconds"))
    each = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    right = probing.join(counts, "bucket").select("id", "vec", "bucket", each, F.lit(1).alias("kind"), F.lit(0).alias("second"), "seconds")
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = left.unionByName(right).repartition(parts, "bucket", "chunk").sortWithinPartitions("bucket", "chunk", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, at, held, own = _Best(k), None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("bucket", "chunk", "kind")], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            ids, x, second = batch.column("id").to_numpy(), _matrix(batch.column("vec"), dims), batch.column("second").to_numpy()
            for a, b in zip(np.concatenate(([0], cuts)).tolist(), np.append(cuts, len(key)).tolist(), strict=True):
                here = tuple(key[a, :2])
                if here != at:
                    at, held, own = here, [], None
                if key[a, 2] == 0:
                    held.append((ids[a:b], x[a:b], second[a:b]))
                elif held or own is not None:
                    if own is None:
                        own = _distinct(*(np.concatenate(c) for c in zip(*held, strict=True)), k)
                        held = []
                    yield from best.add(*own, ids[a:b], x[a:b], batch.column("seconds").slice(a, b - a))
        yield from best.flush()

    return rows.mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def fitted_probes(rows: DataFrame, space: Space, k: int, sample: int = SAMPLE, target: float = TARGET) -> int:
    """The least number of probes a table that reaches ``target`` of the true neighbours of ``sample`` queries among all rows."""
    picked = rows.where("q").orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "vec").toArrow()
    if not picked.num_rows:
        return 1
    ids, x = picked.column(0).to_numpy(), _matrix(picked.column(1).combine_chunks(), space.dims)
    shared = rows.sparkSession.sparkContext.broadcast((ids, x))

    def nearest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        held: list[tuple] = []
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                other, v = batch.column(0).to_numpy(), _matrix(batch.column(1), space.dims)
                score = np.where(own[:, None] == other[None, :], -np.inf, q @ v.T)
                top = np.argpartition(-score, min(k, len(v)) - 1, axis=1)[:, :k]
                row = np.repeat(np.arange(len(own)), top.shape[1])
                col = top.ravel()
                held.append((row, other[col], score[row, col], v[col]))
                if len(held) > 20:
                    held = [_merged(held)]
        if held:
            row, vec_id, score, v = _merged(held)
            ok = score > -np.inf
            vec = pa.FixedSizeListArray.from_arrays(pa.array(v[ok].ravel()), space.dims).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(row[ok]), pa.array(vec_id[ok]), pa.array(score[ok]), vec], names=["row", "vec_id", "score", "vec"])

    def _merged(held: list[tuple]) -> tuple:
        row, vec_id, score, v = (np.concatenate(c) for c in zip(*held, strict=True))
        best = _top(row, vec_id, score, k)
        return row[best], vec_id[best], score[best], v[best]

    near = rows.select("id", "vec").mapInArrow(nearest_of, "row long, vec_id long, score double, vec array<double>")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id"))
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("row", "vec").toArrow()  # at most sample * k rows
    if not near.num_rows:
        return 1
    q, v = space.query(x)[near.column(0).to_numpy()], space.index(_matrix(near.column(1).combine_chunks(), space.dims))
    rot = space.rotations()
    place = np.min([np.concatenate([rot.place(q[a : a + 200], v[a : a + 200], t) for a in range(0, len(q), 200)]) for t in range(space.tables)], axis=0)
    most = min(FIRST_AXES, 2 * rot.size) * 2 * rot.size
    return int(min(most, np.sort(place)[min(len(place) - 1, int(np.ceil(target * len(place))) - 1)] + 1))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 20,
    tables: int = TABLES,
    probes: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): the k nearest found of each row for which ``is_query`` holds.

    ``probes`` is fitted if not given.
    """
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    vec = F.col(vec_col).cast(kind)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), is_query.alias("q")).where(F.col("id").isNotNull() & _valid(F.col("vec")))
    lengths = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, n = lengths.d, lengths.n
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = stored(rows.where(F.size("vec") == dims).withColumn("norm", norm), "vectors")
    low, high = rows.agg(F.min("norm"), F.max("norm")).first()
    space = Space(dims, high, low < high * (1 - 1e-6), tables, seed)
    queries, base = rows.where("q").select("id", "vec"), rows.select("id", "vec")
    probes = probes or fitted_probes(rows, space, k)
    index = stored(_indexed(base, space, kind), "polytope")
    found = stored(_ranked(_meet(index, _probing(queries, space, kind, probes), dims, k), k), "nearest")
    # The rest: whoever found too few looks at every bucket of the first table.
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min(k, n - 1))
    short = stored(queries.join(full, queries["id"] == full["query_id"], "left_anti"), "short")
    if not short.limit(1).count():
        return found
    axes = 2 * _power(dims + space.lift)
    every = short.select("id", "vec", F.explode(F.sequence(F.lit(0), F.lit(axes - 1))).alias("bucket"), F.array().cast("array<int>").alias("seconds"))
    again = _meet(index.where(F.col("bucket") < axes), every, dims, k)
    return found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(_ranked(again, k))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the 20 nearest of every vector whose id is divisible by 20, against all."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 20 == 0)
