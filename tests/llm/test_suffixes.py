import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cambium.llm import suffixes


def brute(rows, width):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(x[i : i + width] for _, x in texts for i in range(len(x) - width + 1))
    out = []
    for d, x in texts:
        gone = [False] * len(x)
        for i in range(len(x) - width + 1):
            if count[x[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        rest = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out.append((d, len(x), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def texts(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghé ") for _ in range(rng.randint(1, 9)))
    shared = ["".join(word() for _ in range(rng.randint(20, 90))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = ["".join(word() for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            parts += [s[a : a + rng.randint(50, 500)], "".join(word() for _ in range(rng.randint(0, 40)))]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("width", [64, 200])
@pytest.mark.parametrize("many", [suffixes.MANY, 3])
def test_against_brute_force(spark, monkeypatch, width, many):
    """many: with 3, hot anchors go by window hashes instead of suffix arrays; the results are the same."""
    monkeypatch.setattr(suffixes, "MANY", many)
    own = texts(width)
    own += [own[0]] * 3 + ["x" * 700, "ab" * 300, "short", "", "x" * 199, "y" * 201]
    rows = list(enumerate(own)) + [(None, own[1]), (5, own[2]), (900, None)]
    out = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], width)
    assert sorted((tuple(r)[:5] for r in out.collect()), key=str) == brute(rows, width)


def test_kept_bytes_clashes_and_empty_table(spark):
    rows = [(1, "q" * 500, 1, 2), (2, "one of its own", 3, 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, low long, anchor long")
    got = {r["doc_id"]: r for r in suffixes.without_repeats(frame, ["doc_id", "low"]).collect()}
    assert got[1]["n_removed"] == 500 and bytes(got[2]["kept_bytes"]) == b"one of its own" and got[2]["low"] == 3
    assert suffixes.without_repeats(frame.limit(0), ["doc_id"]).count() == 0


def test_core_on_small_alphabets():
    rng = random.Random(4)
    for _ in range(400):
        width, letters = rng.randint(1, 6), rng.choice([b"ab", b"abc", b"a", b"\x00\x01\xff"])
        own = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(1, 6))]
        count = Counter(x[i : i + width] for x in own for i in range(len(x) - width + 1))
        want = [(r, i) for r, x in enumerate(own) for i in range(len(x) - width + 1) if count[x[i : i + width]] > 1]
        assert sorted((r, i) for r, a, b in suffixes.repeated(own, width) for i in range(a, b)) == want


def test_order_is_that_of_suffixes():
    rng = random.Random(9)
    raw = bytes(rng.choice(b"abc") for _ in range(400))
    text = np.append(np.frombuffer(raw, np.uint8).astype(np.uint16) + 1, 0).astype(np.uint16)
    needed = np.append(np.ones(400, bool), False)
    assert suffixes.suffix_order(text, needed, 400).tolist() == sorted(range(400), key=lambda i: raw[i:])


def test_long_text_goes_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 1 << 10)
    rng = random.Random(1)
    unique = "".join(rng.choice("abcdefghij") for _ in range(9000))
    rows = [(1, unique), (2, "z" + unique[2000:6000] + "y"), (3, "plain")]
    out = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"])
    assert sorted((tuple(r)[:5] for r in out.collect()), key=str) == brute(rows, 200)
