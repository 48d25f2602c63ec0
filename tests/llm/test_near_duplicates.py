"""Near-duplicates of the pipeline against brute-force shingle similarity."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import SCHEMA
from tidemark.llm import shingle_cover

WS = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = {65 + i: 97 + i for i in range(26)}


def stage(spark, df):
    import corpus_pipeline as cp

    return cp.near_duplicates(spark, df, "")


def shingles(t):
    w = WS.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    both = len(a & b)
    return 5 * both >= 4 * (len(a) + len(b) - both)


def roots_by_hand(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def edited(r, text, share):
    w = text.split()
    for i in r.sample(range(len(w)), max(1, int(share * len(w)))):
        w[i] = f"e{r.randrange(10**6)}"
    return " ".join(w)


def made(seed=3):
    """Texts with edits around a similarity of 0.8, and a passage that many share."""
    r = random.Random(seed)
    text = lambda k: " ".join(f"w{r.randrange(3000)}" for _ in range(k))
    passage, out = text(40), []
    for i in range(60):
        t = text(r.choice([5, 30, 60, 200, 500]))
        if i % 3 == 0:
            t = f"{t} {passage}"
        out += [t, *(edited(r, t, r.choice([0.005, 0.015, 0.02, 0.025, 0.03])) for _ in range(r.choice([0, 1, 3]))), t.upper()]
    return out


def rows(texts):
    return [(i, t, "en", "s", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("run", [2, 1 << 20])
def test_every_pair_at_the_threshold_is_found(spark, monkeypatch, run):
    monkeypatch.setattr(shingle_cover, "RUN", run)
    monkeypatch.setattr(shingle_cover, "BLOCK", run)
    texts = made()
    kept = stage(spark, spark.createDataFrame(rows(texts), SCHEMA))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots_by_hand(texts)))


def test_masks_cover_every_similar_pair():
    r = np.random.default_rng(0)
    for _ in range(2000):
        a = r.integers(0, 1 << 63, size=int(r.integers(1, 300))).astype(np.uint64) * np.uint64(2)
        gone, new = (int(r.integers(0, len(a) // 8 + 1)) for _ in range(2))
        b = np.unique(np.concatenate((a[gone:], r.integers(0, 1 << 63, size=new).astype(np.uint64))))
        a = np.unique(a)
        if shingle_cover.similar(a, b):
            low, high = sorted((a, b), key=len)
            number = shingle_cover.class_of(len(high))
            assert number - shingle_cover.class_of(len(low)) in (0, 1)
            assert set(shingle_cover.mask_keys(low, number).tolist()) & set(shingle_cover.mask_keys(high, number).tolist())


def test_bounds_rule_out_no_similar_pair():
    r = np.random.default_rng(1)
    sets = []
    for _ in range(60):
        a = np.unique(r.integers(0, 1 << 63, size=int(r.choice([1, 3, 30, 62, 66, 130, 500, 2100]))).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        sets += [a] + [np.unique(np.concatenate((a[int(len(a) * x) :], r.integers(0, 1 << 63, size=int(len(a) * y)).astype(np.uint64)))) for x, y in ((0.1, 0.08), (0.0, 0.24), (0.2, 0.0), (0.3, 0.3))]
    odd, n = [shingle_cover.parities(s) for s in sets], np.array([len(s) for s in sets])
    table, ruled_out = shingle_cover.Sketches(n, odd), 0
    for i in range(len(sets)):
        near = set(table.near(int(n[i]), odd[i])[0].tolist())
        for j in range(len(sets)):
            ok = shingle_cover.may_be_similar(int(n[i]), odd[i], int(n[j]), odd[j])
            assert ok == (j in near) and (ok or not shingle_cover.similar(sets[i], sets[j]))
            ruled_out += not ok
    assert ruled_out > 0.95 * len(sets) ** 2


def test_only_confirmed_links_drop_documents(spark):
    """Fingerprints of half-similar texts are often near; none of these may go."""
    r = random.Random(8)
    texts = []
    for _ in range(40):
        base = " ".join(f"w{r.randrange(3000)}" for _ in range(400))
        texts += [base, edited(r, base, 0.04), edited(r, base, 0.06)]
    sets = [shingles(t) for t in texts]
    assert not any(alike(sets[i], sets[j]) for i in range(len(sets)) for j in range(i))
    kept = stage(spark, spark.createDataFrame(rows(texts), SCHEMA))
    assert sorted(x.doc_id for x in kept.collect()) == list(range(len(texts)))


def test_one_row_for_each_component_whatever_its_ids(spark):
    r = random.Random(5)
    a, b, c, d, e, f = (" ".join(f"w{r.randrange(3000)}" for _ in range(80)) for _ in range(6))
    given = [(None, a), (None, b), (None, b), (1, c), (1, d), (1, d), (2, e), (None, e), (3, f), (1, f), (3, edited(r, f, 0.01)), (None, None), (4, ""), (4, " \n")]
    kept = stage(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in given], SCHEMA))
    assert Counter((x.doc_id, x.text) for x in kept.where("doc_id IS NULL OR doc_id < 4").collect()) == Counter([(None, a), (None, b), (1, c), (1, d), (2, e), (1, f)])
    assert kept.where("doc_id = 4").count() == 1 and kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
