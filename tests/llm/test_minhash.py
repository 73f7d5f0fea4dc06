import random

import numpy as np
import pytest

from gridloom.llm import minhash
from gridloom.llm.components import components


def brute(texts, words, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))) if w else frozenset()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    names = sorted(sets)
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                up[hi] = lo
    return {i: (len(sets[i]), root(i)) for i in sets}


def world(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    base = [[word() for _ in range(rng.choice([1, 2, 6, 40, 120, 400]))] for _ in range(n // 6)]
    texts = {}
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(int(len(t) * rng.choice([0, 0.01, 0.05, 0.1, 0.14]))):
            t[rng.randrange(len(t))] = word()
        texts[i * 3 + 1] = rng.choice([" ", "\n", "  "]).join(t)
    return texts | {900: "", 901: None, 902: " \t\n", 903: "One", 904: "oNE", 905: "é É", 906: "a b c", 907: "A B C"}


@pytest.mark.parametrize(("words", "block"), [(2, 4096), (5, 4096), (2, 8)])
def test_components_are_brute_force(spark, monkeypatch, words, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = world(words)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in texts.items()], "doc_id long, text string, component int, leader int")
    got = {r.doc_id: r for r in minhash.near_duplicates(df, words).collect()}
    want = brute(texts, words, 80)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_a_chain_of_near_copies_is_one_component(spark):
    """Neighbours are near duplicates, the ends are not, and the first holds none of most others' bands."""
    rng = random.Random(9)
    t, texts = [f"w{i}" for i in range(200)], {}
    for i in range(40):
        texts[i] = " ".join(t)
        for _ in range(6):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 2).collect()}
    assert got == {i: c for i, (_, c) in brute(texts, 2, 80).items()}
    assert len(set(got.values())) < 5


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(df).collect() == []
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f")], "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(rows).collect()} == {1}


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(1)
    factors, _ = minhash._functions()
    for share in (0.5, 0.8, 0.95):
        pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        both = int(1000 * share)
        a, b = pool[:1000], np.concatenate([pool[:both], pool[1000 : 2000 - both]])
        truth = both / (2000 - both)
        sig = [np.frombuffer(minhash._pack(minhash.minima(x, factors)), dtype=np.uint8) for x in (a, b)]
        assert abs(minhash.estimates(sig[0], sig[1]) - truth) < 0.12
    assert minhash.least_estimate(0.8) < 0.72


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 150)] + [(5, 3), (3, 5), (9, 9), (7, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 151)} | {3: 3, 5: 3, 7: 3}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
