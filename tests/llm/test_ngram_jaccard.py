import itertools
import random

import numpy as np
import pytest

from docmill.llm import ngram_jaccard as m
from docmill.llm.ngram_jaccard import ngram_jaccard_join


def shingles(text, n):
    words = (text or "").encode().lower().split(None) if False else [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)}


def brute(rows, n, num, den):
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and den * len(a & b) >= num * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i in root}


def near_rows():
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows, ident = [], 0
    for _ in range(12):
        text = [rnd.choice(words) for _ in range(rnd.choice([3, 8, 40, 120]))]
        for _ in range(rnd.choice([1, 2, 9])):
            copy = list(text)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            ident += 1
            rows.append((ident, rnd.choice([" ", "\n", " \t"]).join(copy)))
    return [*rows, (900, None), (901, ""), (902, "  \n"), (903, "One two"), (904, "one TWO"), (905, "É é x y"), (906, "é é x y"), (None, "one two"), (903, "One two")]


def test_against_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n string, listed int")
    for n, num, den in ((4, 85, 100), (5, 4, 5)):
        got = ngram_jaccard_join(docs, n=n, num=num, den=den).collect()
        assert len(got) == len(rows)
        want = brute(rows, n, num, den)
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
        sizes = {i: len(shingles(t, n)) for i, t in rows}
        assert all(r.n_shingles == sizes[r.doc_id] for r in got)
        assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_empty(spark):
    assert ngram_jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_wide_units_are_dealt_by_shingle_and_block(spark, monkeypatch):
    monkeypatch.setattr(m, "UNIT", 300)
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_jaccard_join(docs, n=4, num=85, den=100).collect() if r.doc_id is not None}
    assert got == brute(rows, 4, 85, 100)


def crowd_rows():
    """Families of many near copies, and texts that share words with all of them."""
    rnd = random.Random(12)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for _ in range(4):
        text = [rnd.choice(words) for _ in range(60)]
        for _ in range(70):
            copy = list(text) + [rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 8, 40]))]
            for _ in range(rnd.choice([0, 1, 2, 3])):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("sizes", [{"LEAF": 3, "FANOUT": 2, "CROWD": 2, "HOT": 1 << 30}, {"LEAF": 4, "FANOUT": 3, "CROWD": 3, "HOT": 10}, {"CROWD": 1, "HOT": 5, "UNIT": 900}])
def test_crowds_trees_and_hot_shingles(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(m, name, value)
    rows = crowd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n, num, den in ((4, 85, 100), (5, 4, 5)):
        got = {r.doc_id: r.component_id for r in ngram_jaccard_join(docs, n=n, num=num, den=den).collect()}
        assert got == brute(rows, n, num, den)


def test_tree_visits_all_pairs_that_the_bound_lets_pass(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 400)), dtype=np.uint64) * np.uint64(2)) for _ in range(150)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * 0.95)], s[:3] + np.uint64(1)])) for s in sets[:60]]
    size, points = np.array([len(s) for s in sets]), [m.point(s).astype(np.int64) for s in sets]
    for leaf, fanout in ((2, 2), (5, 3), (32, 8)):
        monkeypatch.setattr(m, "LEAF", leaf)
        monkeypatch.setattr(m, "FANOUT", fanout)
        seen = set()
        m.tree_join(size, points, lambda p, q: np.ones((len(p), len(q)), bool), lambda i, j: seen.add((min(i, j), max(i, j))), 4, 5)
        for i, j in itertools.combinations(range(len(sets)), 2):
            if np.minimum(points[i], points[j]).sum() >= m.least_overlap(size[i], size[j], 4, 5):
                assert (i, j) in seen
        assert len(seen) < len(sets) ** 2 / 4


def test_long_texts_that_share_nothing_are_no_candidates():
    """Such pairs once chained 7,008 texts of the larger check table, 6,383 of them linked with none, into one unit."""
    rng = np.random.default_rng(9)
    for n in (990, 3_990, 7_500, 20_000):
        sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)) for _ in range(40)]
        sets.append(np.unique(np.concatenate([sets[0][: int(n * 0.95)], sets[0][:3] + np.uint64(1)])))
        seen = set()
        every = lambda p, q: np.ones((len(p), len(q)), bool)
        m.tree_join(np.array([len(s) for s in sets]), [m._unpacked(m._packed(m.point(s))) for s in sets], every, lambda i, j: seen.add((min(i, j), max(i, j))), 4, 5)
        assert seen == {(0, 40)}, n
