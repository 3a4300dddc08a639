"""The Jaccard join against all pairs, and its parts."""

import random

import numpy as np
import pytest

from graphloom.llm import components, jaccard_join, shingles, words


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[top(i)] = top(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return sorted(out, key=str)


def corpus(seed, n=160):
    """Groups of near copies of several sizes, shared passages, and unrelated texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = r.choices(vocabulary, k=40)
    rows = []
    while len(rows) < n:
        base = r.choices(vocabulary, k=r.choice([3, 7, 30, 60, 120]))
        if r.random() < 0.4:
            base = base + passage
        for _ in range(r.choice([1, 1, 2, 6, 25])):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            if r.random() < 0.2:
                copy = copy + r.choices(vocabulary, k=r.randint(1, 6))
            rows.append((len(rows), r.choice([" ", "\n", "  \t"]).join(x.upper() if r.random() < 0.1 else x for x in copy)))
    return rows


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_copies(df).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs(spark, seed):
    check(spark, corpus(seed))


def test_blocks_of_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE_ROWS", 4)
    monkeypatch.setattr(jaccard_join, "MOST_FREQUENT", 3)
    check(spark, corpus(3, 90))


def test_edges(spark, docs, nothing):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(spark, rows)
    assert jaccard_join.near_copies(nothing).count() == 0
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and jaccard_join.keep_one(nothing).count() == 0
    groups = {c for d, n, c in brute(rows) if n}
    assert sum(bool((r["text"] or "").split()) for r in kept.collect()) == len(groups) + 1, "the text without an id stays too" if None in groups else ""


def test_bitmaps_bound_from_above():
    r = np.random.default_rng(1)
    for _ in range(200):
        n, m = r.integers(1, 400, 2)
        common = r.integers(0, min(n, m) + 1)
        pool = np.unique(r.integers(0, 1 << 63, n + m, np.uint64))
        a, b = np.sort(pool[:n]), np.sort(pool[n - common : n - common + m])
        inter = len(np.intersect1d(a, b))
        if jaccard_join.links(inter, len(a), len(b)):
            x, y = shingles.parity_bitmap(a), shingles.parity_bitmap(b)
            assert jaccard_join.overlap_bound(len(a), x, len(b), y) >= inter
            pairs = jaccard_join.passing(np.array([len(a), len(b)]), [x, y], np.zeros(2, int), np.array([0, 1]))
            assert len(pairs) == 1 and pairs[0, 2] >= inter


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_long_texts_hash_alike(monkeypatch):
    texts = ["a b c " * 50, "x" * 500, "", None, "é ü\n" * 30, "one two"]
    whole = shingles.shingle_sets(texts)
    monkeypatch.setattr(words, "SEGMENT", 32)
    for a, b in zip(whole, shingles.shingle_sets(texts), strict=True):
        assert (a == b).all()


def test_patterns_in_words_do_not_cancel_out(spark):
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    assert len(a) == 1024 and not set(shingles.shingle_sets([a])[0]) & set(shingles.shingle_sets([b])[0])
    for n in (8, 16, 32, 64):
        assert shingles.shingle_sets([a[:n]])[0][0] != shingles.shingle_sets([b[:n]])[0][0]
    check(spark, [(1, a), (2, b), (3, a[:64]), (4, b[:64])])
