import math
import re
from collections import Counter

import numpy as np
import pytest

from cambium.llm import lm
from cambium.llm.trie import STEP, EliasFano, Trie, probabilities

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, m=lm.WEIGHT):
    """The model from its formulas, with dictionaries. 0 is the sign before a text, None its end."""
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + [None] for _, t, _ in rows]
    c, pair, triple, texts = Counter(), Counter(), Counter(), 0
    for own, (_, _, held) in zip(tokens, rows, strict=True):
        if held is False:
            texts += 1
            c.update(own)
            pair.update(zip([0, *own[:-1]], own, strict=True))
            triple.update(zip([0, *own[:-2]], own[:-1], own[1:]))  # a text of its end alone has none
    total, v, out = sum(c.values()), len(c), []
    for own, (doc, _, held) in zip(tokens, rows, strict=True):
        p = [(c[w] + 0.5) / (total + 0.5 * (v + 1)) for w in own]
        s = 0.0
        for i, w in enumerate(own):
            x = own[i - 1] if i else 0
            q = (pair[x, w] + m * p[i]) / ((c[x] if i else texts) + m)
            if i:
                u = own[i - 2] if i > 1 else 0
                q = (triple[u, x, w] + m * q) / (pair[u, x] + m)
            s += math.log10(q)
        out.append((doc, held is not False, len(own), sum(c[w] > 0 for w in own), total, sum(map(math.log10, p)), s))
    return out


@pytest.mark.parametrize(("chunk", "shards"), [(lm.CHUNK, 2_000_000), (2000, 30_000), (50_000, 500)])
def test_against_brute_force(spark, sf, monkeypatch, chunk, shards):
    monkeypatch.setattr(lm, "CHUNK", chunk)
    monkeypatch.setattr(lm, "SHARD", shards)  # few tokens a shard also spread frequent pairs over several
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "doc_id % 5 = 1 as held").limit(60)
    rows = [tuple(r) for r in docs.collect()] + [(1000, None, False), (1001, "", True), (1002, "the " * 3000, False), (None, "The the", False), (1000, "The the", False), (1003, "odd one", None)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string, held boolean").selectExpr("*", "1 as words", "2 as chunk"), "held").collect()
    key = lambda r: (str(r[0]), r[2], r[1])
    want = sorted(brute(rows), key=key)
    for a, b in zip(sorted(map(tuple, got), key=key), want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and abs(a[6] - b[6]) <= STEP * a[2]  # two codes, each off by half a step at most


def test_empty_and_untrained(spark):
    frame = spark.createDataFrame([(1, "a b", True), (2, None, True)], "doc_id long, text string, held boolean")
    assert lm.score(frame.limit(0), "held").count() == 0
    got = {r["doc_id"]: r for r in lm.score(frame, "held").collect()}
    assert got[1]["n_tokens"] == 3 and got[1]["n_known"] == 0 and got[1]["train_tokens"] == 0 and got[1]["base_score"] == 0 and got[2]["n_tokens"] == 1


def test_held_out_text_is_better_told_than_by_words_alone(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "crc32(cast(doc_id as string)) % 5 = 1 as held")
    base, model = lm.score(docs, "held").where("held_out").selectExpr("sum(base_score)", "sum(score)").first()
    assert model > base


@pytest.mark.parametrize(("n", "top"), [(0, 9), (1, 5), (1000, 10**6), (20_000, 2**63), (20_000, 10**7), (500, 2**40)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, top, n, dtype=np.uint64))
    own = EliasFano.build(values)
    assert (own[np.arange(len(values))] == values).all()
    asked = np.concatenate([values, rng.integers(0, top, 500, dtype=np.uint64), np.array([0, top], np.uint64)])
    place = {int(v): i for i, v in enumerate(values)}
    assert own.find(asked).tolist() == [place.get(int(x), -1) for x in asked]


@pytest.mark.parametrize("mapped", [True, False])
def test_trie_on_a_memory_map(tmp_path, mapped):
    rng = np.random.default_rng(2)
    triples = np.unique(np.concatenate([rng.integers(0, 12, (3000, 3)), rng.integers(0, 2**40, (500, 3))]).astype(np.uint64), axis=0)
    count = rng.integers(1, 9, len(triples))
    pairs, of = np.unique(triples[:, :2], axis=0, return_inverse=True)
    sizes = np.bincount(of.reshape(-1))
    times = np.where(rng.random(len(pairs)) < 0.1, 0, np.bincount(of.reshape(-1), count).astype(np.int64))
    total = int(count.sum())
    own = Trie.build(pairs[:, 0], pairs[:, 1], times, sizes, triples[:, 2], count, total).mapped(str(tmp_path / "x") if mapped else None)
    assert not mapped or not list((tmp_path / "x").iterdir())
    got_pairs, got = own.query(pairs[:, 0], pairs[:, 1], sizes, triples[:, 2])
    assert np.allclose(probabilities(got_pairs) * total, times, rtol=1e-3) and np.allclose(probabilities(got) * total, count, rtol=1e-3)
    # any questions, in and out of what is there
    known = {tuple(t): int(n) for t, n in zip(triples.tolist(), count, strict=True)}
    asked = np.unique(rng.integers(0, 14, (2000, 3)).astype(np.uint64), axis=0)
    some, of = np.unique(asked[:, :2], axis=0, return_inverse=True)
    _, got = own.query(some[:, 0], some[:, 1], np.bincount(of.reshape(-1)), asked[:, 2])
    assert np.rint(probabilities(got) * total).astype(int).tolist() == [known.get(tuple(t), 0) for t in asked.tolist()]
