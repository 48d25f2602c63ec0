"""Quality rules, line, near and substring dedup against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES, SCHEMA, clash
from tidemark.llm import bloom, components, line_dedup, quality_rules, simhash, substring_dedup

WS = re.compile(r"[^\x20\x09-\x0d]+")


def words(t):
    return WS.findall(t or "")


def made(seed=1, n=120):
    """Documents with copies, near copies, shared lines and passages."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["ÉtÉ", "ßx", "日本"]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, line = text(70), "Shared LINE of many"
    out = []
    for i in range(n):
        t = text(r.choice([0, 1, 3, 40, 90, 160]))
        kind = i % 6
        if kind == 1 and out:
            t = r.choice(out)
        elif kind == 2 and out:
            w = r.choice(out).split(" ")
            w[r.randrange(len(w))] = "edited"
            t = " ".join(w)
        elif kind == 3:
            cut = r.randrange(0, 20)
            t = f"{t} {' '.join(passage.split()[cut : cut + r.choice([48, 49, 50, 51])])} {text(5)}"
        elif kind == 4:
            t = f"{t}\n {line.lower() if i % 4 else line}\t\n{text(4)}"
        out.append(t)
    return [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA)


def ledger_row(t):
    w = words(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, docs, edges):
    for df in (docs, edges, clash(edges, "n_words", "failed_mask", "kept")):
        got = quality_rules.apply_policy(quality_rules.ledger(df.withColumn("t", F.col("text")))).collect()
        for r in got:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == ledger_row(r.t), r.t
            assert bool(r.failed_mask & 1) == (r.n_words < 50) and r.kept == (r.failed_mask == 0)


def test_quality_filter_and_ablation(spark, nothing, edges):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good, "en", "a", 1), (2, "A!! B!! " * 40, "en", "a", 1), (3, " ".join(f"x{i}%%%" for i in range(80)), "en", "a", 1), (4, good.upper(), "en", "a", 1), (5, "same line here\n" * 40 + good, "en", "a", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = quality_rules.filter_documents(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [1]
    table = {r.rule: (r.n_failed, r.n_only_this, r.n_docs) for r in quality_rules.ablation(quality_rules.ledger(df)).collect()}
    assert table["symbols"] == (1, 1, 5) and table["shouting"] == (1, 1, 5) and table["too_short"] == (0, 0, 5)
    assert quality_rules.filter_documents(nothing).count() == 0
    assert sum(r.n_failed for r in quality_rules.ablation(quality_rules.ledger(edges), "base-1").collect()) > 0


def test_quality_is_native(spark, edges):
    plan = quality_rules.apply_policy(quality_rules.ledger(edges))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def lines_by_hand(rows, min_docs, first=False):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate({65 + i: 97 + i for i in range(26)})
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    start = {}
    for doc, t in rows:
        for i, x in enumerate((t or "").split("\n")):
            k = key(x)
            at = (1 << 63) - 1 if doc is None else doc, i
            start[k] = min(start.get(k, at), at)
    out = []
    for doc, t in rows:
        ls = (t or "").split("\n")
        own = (1 << 63) - 1 if doc is None else doc
        kept = [x for i, x in enumerate(ls) if seen[key(x)] < min_docs or (first and start[key(x)] == (own, i))]
        out.append(("\n".join(kept), len(ls), len(ls) - len(kept)))
    return sorted(out)


@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_line_dedup(spark, docs, edges, limit, keep):
    for df, least in ((docs, 10), (docs, 2), (edges, 2)):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        out = line_dedup.drop_repeated_lines(clash(df, "n_lines"), min_docs=least, keep=keep, broadcast_bytes=limit)
        assert sorted((r.text, r.n_lines, r.n_dropped) for r in out.collect()) == lines_by_hand(rows, least, keep == "first")


def test_line_dedup_empty(nothing):
    out = line_dedup.drop_repeated_lines(nothing)
    assert out.count() == 0 and out.columns == [*nothing.columns, "n_lines", "n_dropped"]
    with pytest.raises(ValueError):
        line_dedup.drop_repeated_lines(nothing, keep="some")


def test_twice_filter_has_no_false_negatives(spark):
    rows = [(f"only {i}\nboth {i // 2}",) for i in range(3000)]
    filt = line_dedup.twice_filter(spark.createDataFrame(rows, "_td_text string").repartition(7))
    hashes = lambda xs: np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in xs], np.uint64)
    assert bloom.has_bits(filt, hashes(f"both {i}" for i in range(1500))).all()
    assert bloom.has_bits(filt, hashes(f"only {i}" for i in range(3000))).mean() < 0.05


def fingerprint_by_hand(t, size=3):
    w = [x.translate({65 + i: 97 + i for i in range(26)}) for x in words(t)]
    runs = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    votes = [0] * 64
    for x in runs:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if runs and 2 * votes[b] > len(runs))


def classes_by_hand(rows, radius):
    fps = [f for _, f in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [least.get(find(i)) for i in range(len(rows))]


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 2])
def test_simhash_classes(spark, docs, edges, bucket):
    for df in (docs, clash(edges, "fp", "component_id", "n")):
        rows = [(r.doc_id, fingerprint_by_hand(r.text)) for r in df.collect()]
        want = Counter((d, f, c) for (d, f), c in zip(rows, classes_by_hand(rows, 2), strict=True))
        got = Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.classes(df, bucket=bucket).collect())
        assert got == want


def test_spark_hash_is_the_contract_hash(spark):
    t = "héllo wörld x"
    assert spark.sql(f"SELECT xxhash64('{t}') h").first().h & (1 << 64) - 1 == xxhash.xxh64_intdigest(t.encode(), 42)


@pytest.mark.parametrize("radius", [1, 2, 3, 4, 5, 6, 7])
def test_covering(radius):
    masks = simhash.covering_masks(radius, list(range(64)))
    r = random.Random(radius)
    for _ in range(2000):
        flip = sum(1 << b for b in r.sample(range(64), r.randint(1, radius)))
        assert any(m & flip == 0 for m in masks)
    assert len(masks) == 2 ** (radius + 1) - 1 and all(m.bit_count() > (20 if radius < 7 else 12) for m in masks)


def test_links_of_dense_fingerprints(spark):
    r = random.Random(4)
    base = r.getrandbits(64)
    values = {base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(150)}
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    for bucket in (2048, 3):
        got = {r.node & (1 << 64) - 1: r.root for r in components.connected_components(simhash.link_edges(frame, 2, bucket)).collect()}
        want = classes_by_hand([(i, v) for i, v in enumerate(values)], 2)
        groups = Counter(want)
        assert len(got) == len(values) - len(groups)


def test_components(spark):
    r = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(50), r.randrange(50)) for _ in range(30)] + [(7, 7), (500, 501), (501, 500), (None, 3)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in chain:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components.connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def passages_by_hand(rows, length):
    ids = [(1 << 63) - 1 if d is None else d for d, _ in rows]
    first = {}
    for d, (_, t) in zip(ids, rows, strict=True):
        w = words(t)
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, (doc, t) in zip(ids, rows, strict=True):
        w = words(t)
        gone = {j for i in range(len(w) - length + 1) if first[tuple(w[i : i + length])] < d for j in range(i, i + length)}
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return Counter(out)


@pytest.mark.parametrize("length, hot", [(50, 2048), (50, 1), (12, 2048), (12, 3), (3, 2048), (1, 2048), (1, 1)])
def test_substring_dedup(spark, monkeypatch, docs, edges, length, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    for df in (docs, clash(edges, "factors", "n_words")):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        out = substring_dedup.drop_repeated_passages(df, length=length)
        got = out.collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == passages_by_hand(rows, length)
        for r in got:
            assert all(f.source < (r.doc_id if r.doc_id is not None else 1 << 63) and f.words >= length for f in r.factors)


def test_words_of_one_pattern_are_told_apart(spark):
    """Thue-Morse words: structured hashes take a word of 1,024 letters for its complement."""
    morse = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    other = morse.translate(str.maketrans("ab", "ba"))
    around = [f"w{i}" for i in range(49)]
    texts = [" ".join([*around[:20], w, *around[20:]]) for w in (morse, other, other)]
    out = substring_dedup.drop_repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r.n_removed for r in out.orderBy("doc_id").collect()] == [0, 0, 50]


def test_very_long_and_repetitive_texts(spark):
    r = random.Random(9)
    long = " ".join(f"v{r.randrange(40)}" for _ in range(30000))
    rows = [(1, "a b " * 4000), (2, "b a " * 300 + "c " * 60), (3, f"x {long}"), (4, f"{long[:60000]} y z {long[60000:]}"), (5, "c " * 50)]
    out = substring_dedup.drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in out.collect()) == passages_by_hand(rows, 50)


def test_window_ranks_name_windows():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 3, size=400)
    for length in (1, 2, 3, 5, 8, 50):
        ranks = substring_dedup.window_ranks(words, length)
        kinds = {}
        for i, k in enumerate(ranks.tolist()):
            assert kinds.setdefault(k, tuple(words[i : i + length])) == tuple(words[i : i + length])
        assert len(kinds) == len({tuple(words[i : i + length]) for i in range(len(words) - length + 1)})


def test_substring_dedup_empty(nothing):
    assert substring_dedup.drop_repeated_passages(nothing).count() == 0


def test_query_digests(spark, sf):
    for module in (line_dedup, substring_dedup, simhash):
        assert module.query(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    row = line_dedup.query(spark, sf).first()
    assert len(row.kept_sha256) == len(hashlib.sha256(b"").hexdigest())


def test_edges_are_what_they_claim():
    assert any(t is None for _, t, *_ in EDGES) and len({e for e in EDGES}) < len(EDGES)
