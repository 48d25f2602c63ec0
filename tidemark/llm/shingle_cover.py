"""Near-duplicates by exact shingle similarity, found through covering masks.

Majority fingerprints of 64 bits cannot promise a similarity of 0.8: such
pairs differ in some ten bits.  So the masks cover the wide fingerprint
itself, the set of a text's hashed shingles seen as a sparse bit vector.

Sets of similarity 0.8 or more differ in at most a ninth of their summed
sizes.  For a class of sizes that is a radius ``k``, and the hash space is cut
into ``m > k`` masks (ranges of hashes): a pair within the radius is equal
under ``m - k`` of them or more, so it meets in some table.  A mask under
which a set is empty gives no key, unless a set is empty under ``m - k`` or
more; ``m`` is chosen so that this is rare.  Sizes of one class are within
5/4, so a set enters the tables of its own class and of the next.

Only distinct sets meet.  The members of a bucket are first compared with its
smallest one, by exact bounds from sizes and parities.  Where members are then
still in different components, each is compared with the one elsewhere that
looks closest, and at last all that the bounds do not rule out, in pairs of
blocks that give joining links only, never pairs.  Every link is confirmed by the exact similarity of the two sets (of 64-bit hashes).

Defined results: letters A-Z count as a-z; fewer words than a shingle has are
one shingle; null and blank texts are copies of one another; of a component
the row with the smallest id stays (null ids come last, then the text's hash
decides), one row for each component, also where ids are null or repeat; an
empty table gives no rows; other columns are kept, whatever their names; a
text may be as long as a row can be.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import mix64, release, run_hashes, small, stored, text_of, word_hashes
from tidemark.llm.components import connected_components

#: Similarity as a fraction.
SIMILAR = 4, 5
#: Members of an open bucket that are compared at a time.
BLOCK = 1024
#: A run of equal keys beyond this many sets goes under its key as it streams by.
RUN = 1 << 20


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    words, counts = word_hashes([t.lower() for t in texts])
    runs = run_hashes(words, size)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(runs[at : at + n - size + 1]))
        else:
            out.append(run_hashes(words[at : at + n], n) if n else words[:0])
        at += n
    return out


def set_key(found: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(found.tobytes()), np.uint64).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    num, den = SIMILAR
    if num * max(len(a), len(b)) > den * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


@cache
def size_class(number: int) -> tuple[int, int, int]:
    """(smallest size, largest size, masks) of a class."""
    num, den = SIMILAR
    low = 1 if not number else size_class(number - 1)[1] + 1
    high = den * low // num
    radius = (den - num) * 2 * high // (den + num)
    masks = radius + 1
    while radius:
        empty = masks * (1 - 1 / masks) ** low
        if masks - radius > empty + 2 * empty**0.5:
            break
        masks += 1
    return low, high, masks


def class_of(n: int) -> int:
    number = 0
    while size_class(number)[1] < n:
        number += 1
    return number


def mask_keys(found: np.ndarray, number: int) -> np.ndarray:
    """The keys of a set under the masks of a class."""
    low, high, masks = size_class(number)
    radius = (SIMILAR[1] - SIMILAR[0]) * 2 * high // sum(SIMILAR)
    # Hashes are sorted, and so are the masks they fall under.
    mask = ((found >> np.uint64(32)) * np.uint64(masks)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], mask[1:] != mask[:-1])))
    own = mask[first]
    inside = np.add.reduceat(mix64(found), first)
    if masks - len(own) >= masks - radius:
        none = np.setdiff1d(np.arange(masks, dtype=np.uint64), own)
        own, inside = np.concatenate((own, none)), np.concatenate((inside, np.zeros(len(none), np.uint64)))
    return mix64(inside ^ mix64(own + np.uint64(number << 32)))


def parity_bits(n: int) -> int:
    """Classes of hashes for a set of ``n``: two or more for each of them, a power of two."""
    return max(64, 1 << (2 * n - 1).bit_length()) if n else 64


def parities(found: np.ndarray) -> bytes:
    """For each class of hashes (their low bits) whether the set has an odd number of it."""
    bits = parity_bits(len(found))
    return np.packbits(np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def folded(odd: np.ndarray) -> np.ndarray:
    """The parities of half as many classes; ``odd`` has 64-bit words in its last axis."""
    half = odd.shape[-1] // 2
    return odd[..., :half] ^ odd[..., half:]


def may_be_similar(n: int, odd: bytes, m: int, other: bytes) -> bool:
    """False only where sizes or parities rule it out.

    Similar sets differ in at most (den - num) / (den + num) of their summed sizes, parities in no more than that.
    """
    num, den = SIMILAR
    if num * max(n, m) > den * min(n, m):
        return False
    a, b = np.frombuffer(odd, np.uint64), np.frombuffer(other, np.uint64)
    while len(a) > len(b):
        a = folded(a)
    while len(b) > len(a):
        b = folded(b)
    return (den + num) * int(np.bitwise_count(a ^ b).sum()) <= (den - num) * (n + m)


class Sketches:
    """Sizes and parities of many sets, in one matrix for each number of classes."""

    def __init__(self, n: np.ndarray, odd: list[bytes]) -> None:
        self.n = n
        words = np.array([len(x) // 8 for x in odd])
        self.rows: dict[int, np.ndarray] = {int(w): np.flatnonzero(words == w) for w in np.unique(words)}
        self.whole = {w: np.frombuffer(b"".join([odd[i] for i in r.tolist()]), np.uint64).reshape(len(r), w) for w, r in self.rows.items()}
        self.half = {w: folded(x) for w, x in self.whole.items() if w > 1}

    def near(self, n: int, odd: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The sets that sizes and parities let be similar to one of ``n`` with parities ``odd``, and how far apart they look."""
        num, den = SIMILAR
        own = np.frombuffer(odd, np.uint64)
        out, far = [np.zeros(0, np.int64)], [np.zeros(0)]
        # Sizes within 5/4 of each other are at most one doubling apart.
        for w, mine, theirs in ((len(own), own, self.whole), (2 * len(own), own, self.half), (len(own) // 2, folded(own) if len(own) > 1 else own, self.whole)):
            if w not in self.rows or (w < len(own) and len(own) == 1):
                continue
            rows, m = self.rows[w], self.n[self.rows[w]]
            at = np.flatnonzero(num * np.maximum(m, n) <= den * np.minimum(m, n))
            apart = np.bitwise_count(theirs[w][at] ^ mine).sum(axis=1, dtype=np.int64)
            ok = (den + num) * apart <= (den - num) * (m[at] + n)
            out.append(rows[at[ok]])
            far.append(apart[ok] / (m[at[ok]] + n))
        return np.concatenate(out), np.concatenate(far)


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    release()
    for batch in (s for b in batches for s in small(b)):
        yield batch, shingle_sets(batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist(), size)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(mask keys, set keys, own, smallest set key of its run) of rows sorted by both; whole runs but for long ones."""
    parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0, bool)]]
    held, low = 0, {}

    def give(last: bool) -> Iterator[tuple]:
        nonlocal parts, held
        sig, key, own = (np.concatenate(x) for x in zip(*parts, strict=True))
        full = len(sig) if last else int(np.searchsorted(sig, sig[-1])) if len(sig) else 0
        if not last and len(sig) - full > RUN:
            low.setdefault(int(sig[-1]), int(key[full]))
            full = len(sig)
        parts, held = [[sig[full:], key[full:], own[full:]]], len(sig) - full
        sig, key, own = sig[:full], key[:full], own[:full]
        if full:
            new = np.concatenate(([True], sig[1:] != sig[:-1]))
            first = key[np.maximum.accumulate(np.where(new, np.arange(full), 0))]
            for end in {int(sig[0]), int(sig[-1])} & low.keys():
                first[sig == end] = low[end]
                own = own | (sig == end)
            yield sig, key, own, first

    for batch in batches:
        parts.append([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)])
        held += batch.num_rows
        if held >= 1 << 18:
            yield from give(False)
    yield from give(True)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, set key, smallest) of the buckets of two or more sets; equal buckets of a task leave once."""
    seen: set[int] = set()
    for sig, key, own, first in _runs(batches):
        fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])))
        of = np.cumsum(np.concatenate(([True], sig[1:] != sig[:-1]))) - 1
        count = np.bincount(of[fresh])
        mine = np.bincount(of, weights=own) > 0
        whole = (count > 1) & mine | (first != key).astype(bool)[np.searchsorted(of, np.arange(len(count)))]
        at = np.flatnonzero(fresh & whole[of])
        if not len(at):
            continue
        starts = np.flatnonzero(np.concatenate(([True], of[at][1:] != of[at][:-1])))
        name = np.add.reduceat(mix64(key[at].view(np.uint64)), starts).view(np.int64)
        size = np.diff(np.append(starts, len(at)))
        name = np.where(size > RUN, sig[at[starts]], name)
        keep = np.array([n not in seen and not seen.add(n) for n in name.tolist()])
        if len(seen) > RUN:
            seen.clear()
        pick = np.repeat(keep, size)
        cols = [pa.array(np.repeat(name, size)[pick]), pa.array(key[at][pick]), pa.array(first[at][pick])]
        yield pa.RecordBatch.from_arrays(cols, names=["bucket", "key", "low"])


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that sizes and parities do not rule out."""
    for batch in (s for b in batches for s in small(b, 2000)):
        n, a, m, b = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
        yield batch.select([0, 1]).filter(pa.array(list(map(may_be_similar, n, a, m, b)), pa.bool_()))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (s for b in batches for s in small(b)):
        a, b = (batch.column(k).to_pylist() for k in (2, 3))
        ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True)]
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (s for b in batches for s in small(b)):
        sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
        cols = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([parities(s) for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["key", "n", "odd"])


class _Pair:
    """Two blocks of a bucket: for each set of the left one, those of the right that are elsewhere and may be similar."""

    def __init__(self, table: pa.Table) -> None:
        self.key, self.root, side, self.n = (table.column(c).to_numpy() for c in ("key", "root", "block", "n"))
        self.odd = table.column("odd").to_pylist()
        self.i, self.j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        self.left, self.right = np.flatnonzero(side == self.i), np.flatnonzero(side == self.j)
        self.sketches = Sketches(self.n[self.right], [self.odd[k] for k in self.right.tolist()])

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for a in self.left.tolist():
            rows, far = self.sketches.near(int(self.n[a]), self.odd[a])
            rows = self.right[rows]
            ok = (self.root[rows] != self.root[a]) & ((self.key[rows] > self.key[a]) | (self.i != self.j))
            if ok.any():
                yield a, rows[ok], far[ok]


def _pairs(src: list, dst: list) -> pa.Table:
    a, b = np.array(src, dtype=np.int64), np.array(dst, dtype=np.int64)
    return pa.table({"src": pa.array(np.maximum(a, b)), "dst": pa.array(np.minimum(a, b))})


def _closest(table: pa.Table) -> pa.Table:
    """For each set the one that looks closest: as many pairs as sets."""
    pair = _Pair(table)
    found = [(a, rows[np.lexsort((pair.key[rows], far))[0]]) for a, rows, far in pair]
    return _pairs([pair.key[a] for a, _ in found], [pair.key[b] for _, b in found])


def _hopeful(table: pa.Table) -> pa.Table:
    """The sets of two blocks that may be similar to one in another component."""
    pair = _Pair(table)
    hope = np.zeros(len(pair.key), bool)
    for a, rows, _ in pair:
        hope[a] = hope[rows] = True
    return table.select(["bucket", "i", "j", "block", "key", "root"]).filter(pa.array(hope))


def _across(table: pa.Table) -> pa.Table:
    """Links that join what similar sets of two blocks are in different components: fewer than sets."""
    sets = [np.frombuffer(x, np.uint64) for x in table.column("found").to_pylist()]
    with_sketch = table.drop_columns(["found"]).append_column("n", pa.array([len(s) for s in sets], pa.int64())).append_column("odd", pa.array([parities(s) for s in sets], pa.binary()))
    pair = _Pair(with_sketch)
    label = np.unique(pair.root, return_inverse=True)[1]
    src, dst = [], []
    for a, rows, _ in pair:
        for b in rows.tolist():
            if label[b] != label[a] and similar(sets[a], sets[b]):
                src.append(pair.key[a])
                dst.append(pair.key[b])
                label[label == label[b]] = label[a]
    return _pairs(src, dst)


def _opened(members: DataFrame, sketches: DataFrame, near: DataFrame) -> DataFrame:
    """Pairs of blocks of the buckets whose members are in several components, grouped."""
    labelled = members.join(near, F.col("key") == F.col("node"), "left").select("bucket", "key", F.coalesce("root", "key").alias("root"))
    labelled = stored(labelled, "labels")
    # A bucket of two has been settled by its star.
    span = labelled.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("size"))
    span = span.where("a != b AND size > 2").select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    left = labelled.join(span, "bucket").withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int")).join(sketches, "key")
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return left.select("bucket", "i", "j", "block", "key", "root", "n", "odd").groupBy("bucket", "i", "j")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``src``, ``dst``) whose sets are similar."""
    keys = pairs.select(F.explode(F.array("src", "dst")).alias("key")).distinct()
    wanted = stored(sets.join(keys, "key", "left_semi"), "pair-sets")
    one = pairs.join(wanted.select(F.col("key").alias("src"), F.col("found").alias("a")), "src")
    both = one.join(wanted.select(F.col("key").alias("dst"), F.col("found").alias("b")), "dst")
    return both.select("src", "dst", "a", "b").mapInArrow(_confirm, "src long, dst long")


def components(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(``id``, ``h``, ``root``) for every row: its id, the hash of its text and its component."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("h"), text_of(text_col).alias("text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, size):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([set_key(s) for s in sets], pa.int64())], names=["id", "h", "key"])

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _sets(batches, size):
            found, key, own = [np.zeros(0, np.uint64)], [], []
            for s in sets:
                k = set_key(s)
                if not len(s) or k in seen:
                    continue
                seen.add(k)
                number = class_of(len(s))
                for step in (0, 1):
                    found.append(mask_keys(s, number + step))
                    key.append(np.full(len(found[-1]), k))
                    own.append(np.full(len(found[-1]), step == 0))
            if len(seen) > RUN:
                seen.clear()
            if key:
                cols = [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(key)), pa.array(np.concatenate(own))]
                yield pa.RecordBatch.from_arrays(cols, names=["sig", "key", "own"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, size):
            cols = [pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "found"])

    keyed = stored(rows.mapInArrow(keys, docs.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("h")).schema.add("key", "long")), "set-keys")
    sigs = rows.select("text").mapInArrow(masked, "sig long, key long, own boolean")
    met = sigs.repartition(parts, "sig").sortWithinPartitions("sig", "key").mapInArrow(_buckets, "bucket long, key long, low long")
    members = stored(met.distinct(), "buckets")

    # One text of each set that met another.
    wanted = keyed.join(members.select("key").distinct(), "key", "left_semi").groupBy("key")
    wanted = wanted.agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("m")).select(F.col("m.id").alias("_td_id"), F.col("m.h").alias("_td_h"))
    texts = rows.join(wanted, (F.col("h") == F.col("_td_h")) & F.col("id").eqNullSafe(F.col("_td_id")), "left_semi")
    sets = stored(texts.select("text").mapInArrow(whole, "key long, found binary").dropDuplicates(["key"]), "sets")

    sketches = stored(sets.mapInArrow(_sketched, "key long, n long, odd binary"), "sketches")
    stars = members.where("key != low").select(F.col("key").alias("src"), F.col("low").alias("dst")).distinct()
    stars = stars.join(sketches.select(F.col("key").alias("src"), F.col("n"), F.col("odd").alias("a")), "src")
    stars = stars.join(sketches.select(F.col("key").alias("dst"), F.col("n").alias("m"), F.col("odd").alias("b")), "dst")
    stars = stored(stars.select("src", "dst", "n", "a", "m", "b").mapInArrow(_plausible, "src long, dst long"), "stars")
    links = stored(_links(stars, sets), "links")
    # The closest ones elsewhere join most of what belongs together; then whatever is left is held against each other.
    closest = _opened(members, sketches, connected_components(links)).applyInArrow(_closest, "src long, dst long")
    links = links.unionByName(stored(_links(stored(closest.distinct(), "closest"), sets), "more-links"))
    left = "bucket long, i int, j int, block int, key long, root long"
    hopeful = stored(_opened(members, sketches, connected_components(links)).applyInArrow(_hopeful, left), "hopeful")
    across = hopeful.join(sets, "key").groupBy("bucket", "i", "j").applyInArrow(_across, "src long, dst long")
    found = connected_components(links.unionByName(stored(across.distinct(), "last-links")))
    return keyed.join(found, F.col("key") == F.col("node"), "left").select("id", "h", F.coalesce("root", "key").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay: of each component of similar texts the one with the smallest id."""
    rows = stored(components(docs, id_col, text_col, size), "classes")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("m")
    first = rows.groupBy("root").agg(best).select(F.col("m.id").alias("_td_id"), F.col("m.h").alias("_td_h"))
    same = F.col("id").eqNullSafe(F.col("_td_id")) & (F.col("h") == F.col("_td_h"))
    first = rows.join(first, same).groupBy("_td_id", "_td_h").agg(F.count(F.lit(1)).alias("_td_n"))
    own = docs.withColumn("_td_own", F.xxhash64(text_of(text_col)))
    kept = own.join(stored(first, "first"), (F.col("_td_own") == F.col("_td_h")) & F.col(id_col).eqNullSafe(F.col("_td_id")))
    once = kept.where("_td_n = 1").select(*docs.columns)
    # Repeats of a row.
    many = kept.where("_td_n > 1").dropDuplicates([id_col, "_td_own"]).select(*docs.columns)
    return once.unionByName(many)
