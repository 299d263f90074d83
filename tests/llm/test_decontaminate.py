import random

import numpy as np

from cambium.llm import decontaminate


def naive(p, t, k):
    in_p, in_t, out = [False] * len(p), [False] * len(t), []
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not in_p[i + n] and not in_t[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < k:
            return out
        in_p[i : i + n] = in_t[j : j + n] = [True] * n
        out.append((n, i, j))


def test_tiling_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        top = rng.randint(2, 5)
        p, t = ([rng.randint(1, top) for _ in range(rng.randint(0, n))] for n in (20, 30))
        k = rng.randint(1, 6)
        assert decontaminate.tiles(np.array(p, np.uint64), np.array(t, np.uint64), k) == naive(p, t, k)


def test_bounded_on_long_repetitive_texts():
    import time
    import tracemalloc

    rng = random.Random(4)
    one, two = np.uint64(11), np.uint64(12)
    cases = [([one] * 200, [one] * 200_000), ([one] * 200, ([one] * 99 + [two]) * 2000), ([one, two] * 100, [one] * 100_000 + [two, one] * 50_000), ([rng.choice([one, two]) for _ in range(200)], [rng.choice([one, two]) for _ in range(100_000)])]
    for p, t in cases:
        tracemalloc.start()
        start = time.process_time()
        made = decontaminate.tiles(np.array(p, np.uint64), np.array(t, np.uint64), 5)
        took, most = time.process_time() - start, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert took < 20 and most < 200 * len(t) and sum(n for n, _, _ in made) > 190
        assert all(p[i : i + n] == t[j : j + n] for n, i, j in made)


def test_query_against_naive_tiling(spark):
    """Every passage against every document, without seeds or hashes of windows."""
    rng = random.Random(6)
    bench = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 25)))) for i in range(12)] + [(3, "a b c"), (20, None)]
    docs = []
    for i in range(60):
        own = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            own += bench[i % 12][1].split()[rng.randint(0, 9) :] + ["z"] + bench[i % 12][1].split()[:12]
        docs.append((i, " ".join(own)))
    got = {d: tuple(r) for d, r in run(spark, docs, bench).items()}
    for d, text in docs:
        found = []
        for item, passage_ in bench:
            p = (passage_ or "").split()
            made = naive(p, text.split(), min(5, len(p))) if p else []
            if made:
                found.append((sum(n for n, _, _ in made) / len(p), item, len(made)))
        best = max(found, key=lambda c: (c[0], -c[1]), default=(0.0, None, 0))
        over = sum(c[0] >= 0.5 for c in found)
        assert got[d][:3] == (d, best[0], best[1]) and got[d][4] == over and got[d][5] == (over > 0)


def passage(seed, n=40):
    rng = random.Random(seed)
    return [f"word{rng.randint(0, 10**6)}" for _ in range(n)]


def run(spark, docs, bench):
    docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as coverage", "2 as item_id")
    bench = spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "3 as doc_id")
    return {r["doc_id"]: r for r in decontaminate.judged(docs, bench, ["doc_id"]).collect()}


def test_whole_reordered_and_partial_passages(spark):
    own = passage(1)
    other = passage(2, 200)
    reordered = own[30:] + other[:20] + own[10:20] + other[20:30] + own[:10] + own[20:30]
    docs = [(1, " ".join(other[:50] + own + other[50:])), (2, " ".join(reordered)), (3, " ".join(other)), (4, " ".join(other[:9] + own[:8] + other[9:40])), (5, " ".join(own[:25]).upper()), (6, ", ".join(own) + "!"), (7, None), (8, ""), (None, " ".join(own))]
    got = run(spark, docs, [(11, " ".join(own)), (12, " ".join(passage(3))), (13, None), (14, "")])
    assert [got[i]["contaminated"] for i in (1, 2, 3, 4, 5, 6, 7, 8, None)] == [True, True, False, False, True, True, False, False, True]
    assert got[1]["item_id"] == 11 and got[1]["coverage"] == 1 and got[2]["n_tiles"] == 4 and got[4]["coverage"] == 8 / 40 and got[3]["coverage"] == 0 and got[3]["item_id"] is None


def test_short_items_ties_and_blocks(spark, monkeypatch):
    docs = [(1, "the secret phrase is here"), (2, "no phrase secret"), (3, " ".join(passage(5)))]
    bench = [(2, "secret phrase"), (1, "Secret, phrase"), (9, " ".join(passage(5)))]
    got = run(spark, docs, bench)
    assert got[1]["contaminated"] and got[1]["item_id"] == 1 and got[1]["n_items"] == 2 and not got[2]["contaminated"] and got[3]["item_id"] == 9
    monkeypatch.setattr(decontaminate, "BLOCK", 1)
    again = run(spark, docs, bench)
    assert {k: (v["contaminated"], v["item_id"], v["coverage"], v["n_items"]) for k, v in again.items()} == {k: (v["contaminated"], v["item_id"], v["coverage"], v["n_items"]) for k, v in got.items()}


def test_empty_tables_and_repeated_rows(spark):
    assert run(spark, [], [(1, "a b c d e f")]) == {}
    assert not run(spark, [(1, "a b c")], [])[1]["contaminated"]
    rows = spark.createDataFrame([(1, "a b c d e f")] * 3, "doc_id long, text string")
    assert decontaminate.judged(rows, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string"), ["doc_id", "text"]).where("contaminated").count() == 3


def test_rows_stay_apart_with_several_blocks(spark, monkeypatch):
    """Rows that share an id, have none, or are equal are judged by themselves, and maps travel along."""
    rows = [(1, "one two three four five six"), (1, "clean"), (None, "clean"), (None, "clean"), (None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None)]
    docs = spark.createDataFrame([(i, t, {"x": 1}) for i, t in rows], "doc_id long, text string, m map<string,int>")
    bench = spark.createDataFrame([(5, "one two three four five six"), (None, "a b c d e f"), (4, "a b c d e f"), (6, None)], "item_id long, text string")

    def judged(keep):
        return sorted((tuple(r) for r in decontaminate.judged(docs, bench, keep).collect()), key=repr)

    want = {tuple(k): judged(k) for k in (["doc_id"], ["doc_id", "text"], ["doc_id", "m", "text"])}
    assert [sum(r[-2] for r in x) for x in want.values()] == [4] * 3
    monkeypatch.setattr(decontaminate, "BLOCK", 1)
    for k, x in want.items():
        assert judged(list(k)) == x and len(x) == len(rows)


def test_planted_passages(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [r["text"][:60] for r in bench.collect()]
    want = {r["doc_id"] for r in docs.collect() if any(i in r["text"] for i in items)}
    assert {r["doc_id"] for r in decontaminate.judged(docs, bench, ["doc_id"]).where("contaminated").collect()} == want
