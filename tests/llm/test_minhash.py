import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cambium.llm import minhash
from cambium.operators.graph import components


def brute(rows, k, percent=80):
    def shingles(text):
        w = [x for x in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\x0b", " ").split()]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [(d, shingles(t)) for d, t in rows]
    label = {d: d for d, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return sorted((d, len(s), root(d), root(d) == d) for d, s in sets)


def family(seed, n, words=60, edits=8):
    """Copies of one text with more and more edits, which form chains and many components."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(words)] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_against_brute_force(spark, k):
    texts = family(1, 120) + family(2, 40, 200, 12) + ["a b", "A  b", "a b c", "", "  ", "x", "X", "Ä x", "ä x"] + ["same text of five words"] * 7
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)] + [(10_000, None)]
    random.Random(3).shuffle(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash.Near(k=k)).collect()
    assert sorted(map(tuple, got)) == brute(rows, k)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b c d e f", 0, "k"), (1, "a b c d e f", 1, "k"), (2, "a b c d e f", 2, "k"), (None, "a b c d e f", 3, "k"), (3, None, 4, "k"), (4, "z " * 9, 5, "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, node long, bands string")
    got = sorted(map(tuple, minhash.near_duplicates(frame).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True), (3, 0, 3, True), (4, 1, 4, True)], key=str)
    assert minhash.near_duplicates(frame.limit(0)).count() == 0


def test_estimate_is_close():
    near = minhash.Near()
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    b = np.concatenate([a[:3200], rng.integers(0, 2**63, 800, dtype=np.uint64)])
    h = minhash.hashers(1024)
    x, y = (minhash.minima(s, *h) for s in (a, b))
    low = lambda v: minhash.packed(v[None], 2)
    same = (x & 3) == (y & 3)
    estimate = (same.mean() - 0.25) / 0.75
    assert abs(estimate - 3200 / 4800) < 0.06 and (x == y).mean() == pytest.approx(3200 / 4800, abs=0.06)
    assert low(x).shape == (1, 32) and near.lanes == 128


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(1, 300)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000), (7000, None)]
    label = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert set(label) == set(range(1, 301)) | set(range(1000, 1200)) and {label[i] for i in range(1, 301)} == {1} and {label[i] for i in range(1000, 1200)} == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_copies_cost_no_pairs(spark):
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three four five six seven").alias("text"))
    assert minhash.near_duplicates(frame).where("kept").collect()[0]["doc_id"] == 0
