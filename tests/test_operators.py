"""Golden cases of operators, with fixtures written for them."""

import random
import re
import time
from collections import Counter
from math import comb, erfc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cambium import catalog
from cambium.functions import responses as P
from cambium.functions import scalars as S
from cambium.functions import stats
from cambium.operators import cohorts as C
from cambium.operators import duplicates as D
from cambium.operators import reports as R
from cambium.operators import scoring as M
from cambium.operators.graph import components
from cambium.plans import duplicate_queries as Q
from tests.conftest import SF
from tests.oracle import TABLES, expected, got


def one(spark, *columns, rows=((0,),), schema="x int"):
    return spark.createDataFrame(list(rows), schema).select(*columns).first()


def test_scalars(spark):
    lit = F.lit
    row = one(
        spark, S.plain_label(lit("Seborrheic-Keratosis")), S.label(lit("Naïve & Café/au_lait")), S.age_group(lit(72)), S.age_group(lit(-1)), S.age_group(lit(None).cast("int"), lit("age_80_or_above")), S.age_group(lit(5), lit("other")),
        S.scale_value(lit("0"), 1, 6), S.scale_value(lit("4.0"), 1, 6), S.scale_value(lit("IV"), 1, 6), S.tone_group(lit("fst_3"), lit("")), S.tone_band(lit("fitzpatrick:FST_56")), S.tone_band(lit("monk:MST_10")), S.tone_group(lit(" nan"), lit("monk")),
        S.optional_text(lit("  ")), S.combined(lit("fst"), lit("unknown")), S.reported(lit(None).cast("string")), S.without_fragment(lit("http://a/b#c")), S.first_of(lit(" "), lit("b")), S.whole_number(lit("3.9")), S.whole_number(lit("-2")),
    )
    assert list(row) == ["seborrheic keratosis", "naive and cafe au lait", "70_and_over", None, "70_and_over", "unknown", None, "4", "IV", "fitzpatrick:FST_3", "fitzpatrick:FST_5-6", "monk:MST_7-10", "unknown", None, None, "missing_or_unknown", "http://a/b", "b", 3, None]


def test_digests_equal_hashlib(spark):
    import hashlib

    row = one(spark, S.digest(42, F.lit("a")), S.score(F.lit("r"), F.lit("1"), F.lit("u")), S.task_seed(42, F.lit("t")), S.stable_id("P", F.lit("v")), S.members_id("G", F.array(F.lit("b"), F.lit("a"), F.lit("b"))))
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert list(row) == [h("42:a"), h("r\0" + "1\0u"), int.from_bytes(hashlib.sha256(b"42:t").digest()[:8], "big") % 2**31, f"P_{h('v')[:24]}", f"G_{h('a' + chr(10) + 'b')[:20]}"]
    assert C.hashed(42, "a") == h("42:a")


FRAME = "sample_id string, dataset_id string, group_id string, disease_id string, diagnosis_basis string, include boolean, exclusion_reason string, image_sha256 string, perceptual_hash long, lineage array<string>"


def sample(i, sha, code=None, disease="D1", group=None, dataset="a", lineage=(), include=True, basis="atlas_label"):
    return (f"S{i}", dataset, group or f"G{i}", disease, basis, include, None, sha, code, list(lineage))


def analyzed(spark, rows, **more):
    return {r["sample_id"]: r for r in D.analyze(spark.createDataFrame(rows, FRAME), D.Policy(contributors=("a",), external=("x",)), **more).collect()}


def test_equal_image_and_label(spark):
    got = analyzed(spark, [sample(1, "same"), sample(2, "same", basis="pathology"), sample(3, "other")])
    assert got["S2"]["deduplication_status"] == "canonical" and got["S1"]["deduplication_status"] == "redundant_exact" and got["S3"]["deduplication_status"] == "unique"
    assert not got["S1"]["include"] and got["S1"]["exclusion_reason"] == "exact_duplicate" and got["S1"]["leakage_group_id"] == got["S2"]["leakage_group_id"] != got["S3"]["leakage_group_id"] == "G3"


def test_equal_image_other_label(spark):
    rows = [sample(1, "same", disease="D1"), sample(2, "same", disease="D2"), sample(3, "same", disease="D2", include=False)]
    got = analyzed(spark, rows)
    assert {r["deduplication_status"] for r in got.values()} == {"exact_label_conflict"} and not any(r["include"] for r in got.values()) and got["S3"]["exclusion_reason"] is None
    decided = spark.createDataFrame([("same", "S2")], "image_sha256 string, canonical_sample_id string")
    got = analyzed(spark, rows, decisions=decided)
    assert got["S2"]["deduplication_status"] == "canonical" and got["S2"]["include"] and not got["S1"]["include"]


def test_near_and_lineage_and_groups(spark):
    rows = [sample(1, "p", 0b1111), sample(2, "q", 0b0000), sample(3, "r", -1), sample(4, "s", None, lineage=["u"]), sample(5, "t", None, lineage=["u"], group="G6"), sample(6, "w", None, group="G6")]
    got = analyzed(spark, rows)
    assert got["S1"]["deduplication_status"] == got["S2"]["deduplication_status"] == "perceptual_candidate" and got["S1"]["duplicate_match_type"] == "perceptual" and got["S3"]["deduplication_status"] == "unique"
    assert got["S4"]["deduplication_status"] == "source_lineage_candidate" and got["S4"]["leakage_group_id"] == got["S6"]["leakage_group_id"] and got["S6"]["duplicate_group_id"] is None and all(r["include"] for r in got.values())
    rejected = spark.createDataFrame([("S1", "S2")], "a string, b string")
    assert analyzed(spark, rows, rejected=rejected)["S1"]["deduplication_status"] == "unique"


def test_reports(spark):
    rows = [sample(1, "p", 0, "D1"), sample(2, "q", 1, "D2", dataset="x"), sample(3, "r", 3, "D1", dataset="a")]
    frame = spark.createDataFrame(rows, FRAME)
    policy = D.Policy(contributors=("a",), external=("x",))
    queue = D.review_queue(D.pair_report(frame, D.evidence(frame, policy)), policy).orderBy("sample_id_a", "sample_id_b").collect()
    assert [r["priority_reason"] for r in queue] == ["mapped_label_conflict", "perceptual_distance_2", "mapped_label_conflict"]
    done = D.analyze(frame.withColumn("before", F.col("include")), policy).withColumn("before", F.lit(True))
    total = {r["dataset_id"]: r for r in D.summary(done, D.group_report(done)).collect()}
    assert total["all_datasets"]["sample_count"] == 3 and total["all_datasets"]["perceptual_candidate_count"] == 3 and total["a"]["cross_dataset_duplicate_sample_count"] == 2


@pytest.mark.parametrize("rejecting", [False, True])
def test_links_make_the_groups_of_all_pairs(spark, rejecting):
    rng = random.Random(3)
    codes = [rng.getrandbits(62) for _ in range(25)]
    rows = []
    for i in range(60):
        code = rng.choice(codes) ^ (1 << rng.randrange(60) if rng.random() < 0.4 else 0)
        rows.append(sample(i, rng.choice([None, f"i{rng.randrange(45)}"]), rng.choice([None, code]), lineage=[f"t{rng.randrange(90)}"] if rng.random() < 0.3 else []))
    frame = spark.createDataFrame(rows, FRAME)
    pairs = D.evidence(frame, D.Policy()).collect()
    rejected = spark.createDataFrame([(r["a"], r["b"]) for r in pairs if "perceptual" in r["kinds"]][::3], "a string, b string") if rejecting else None
    of = lambda edges: {r["node"]: r["label"] for r in components(edges.select("a", "b")).collect()}
    whole = D.evidence(frame, D.Policy(), rejected)
    stars = D.links(frame, D.Policy(), rejected)
    label = of(whole)
    assert of(stars) == label and len(set(label.values())) > 3
    kinds = lambda rows: {(label[a], k) for a, ks in rows for k in ks}
    assert kinds((r["a"], [r["kind"]]) for r in stars.collect()) == kinds((r["a"], r["kinds"]) for r in whole.collect())


def test_blocks_get_longer_as_codes_get_more(spark, monkeypatch):
    assert [D.agreeing(64, 4, n) for n in (100, 10**5, 10**7, 10**9)] == sorted(D.agreeing(64, 4, n) for n in (100, 10**5, 10**7, 10**9)) and D.agreeing(64, 4, 10**9) > D.agreeing(64, 4, 100)
    for r in (2, 3):
        monkeypatch.setattr(D, "agreeing", lambda *_, r=r: r)
        test_near_pairs_against_all_pairs(spark, 4)


@pytest.mark.parametrize("threshold", [0, 2, 4, 9])
def test_near_pairs_against_all_pairs(spark, threshold):
    rng = random.Random(threshold)
    codes = [rng.getrandbits(64) - 2**63 for _ in range(40)]
    codes += [c ^ sum(1 << rng.randrange(63) for _ in range(rng.randint(0, 12))) for c in codes] + codes[:5]
    codes = [(c + 2**63) % 2**64 - 2**63 for c in codes]
    got = {(r["a"], r["b"]): r["distance"] for r in D.near_pairs(spark.createDataFrame([*enumerate(codes), (999, None)], "id long, code long"), threshold).collect()}
    want = {(i, j): n for i in range(len(codes)) for j in range(i + 1, len(codes)) if (n := bin((codes[i] ^ codes[j]) % 2**64).count("1")) <= threshold}
    assert got == want


def code_rows(n, seed=3):
    """Codes of which many are near others, some equal and one null."""
    rng = random.Random(seed)
    codes = [rng.getrandbits(64) for _ in range(n)]
    codes += [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 20))) for c in codes] + codes[:9]
    return [(c + 2**63) % 2**64 - 2**63 for c in codes]


def test_codes_held_against_all_in_blocks(spark):
    """Several blocks, of a size that isn't a multiple of eight or of a strip of rows; each pair comes once."""
    codes = sorted(set(code_rows(60)))
    frame = spark.createDataFrame([(c,) for c in codes], "code long")
    want = {(a, b): n for a in codes for b in codes if a < b and (n := bin((a ^ b) % 2**64).count("1")) <= 15}
    for block in (8192, 37, 9):
        found = [(min(r["p"], r["q"]), max(r["p"], r["q"]), r["distance"]) for r in D.held_against_all(frame, len(codes), 15, block).collect()]
        assert len(found) == len(want) > 30 and {(p, q): n for p, q, n in found} == want


@pytest.mark.parametrize("threshold", [4, 15])
def test_near_pairs_broadcast_no_keys_or_pairs(spark, threshold):
    """Spark judges a table of codes by its files and would broadcast its keys, many for each code, through the driver."""
    assert D.selective(64, 4, D.agreeing(64, 4, 200)) and not D.selective(64, 15, D.agreeing(64, 15, 10**9))
    frame = spark.createDataFrame([*enumerate(code_rows(60)), (999, None)], "id long, code long")
    pairs = D.near_pairs(frame, threshold)
    codes = [r["code"] for r in frame.orderBy("id").collect()][:-1]
    want = {(i, j): n for i in range(len(codes)) for j in range(i + 1, len(codes)) if (n := bin((codes[i] ^ codes[j]) % 2**64).count("1")) <= threshold}
    rows = pairs.collect()
    assert len(rows) == len(want) and {(r["a"], r["b"]): r["distance"] for r in rows} == want
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"SortMergeJoin \[p#", plan) and not re.search(r"BroadcastHashJoin \[blocks#", plan)
    assert "FlatMapGroupsInArrow" in plan if threshold == 15 else re.search(r"SortMergeJoin \[blocks#", plan)


def test_near_components_make_no_pairs_of_copies(spark, tmp_path):
    """3,000 copies of a vector are tied by 2,999 edges, not by 4,498,500."""
    vectors = [[1.0] * 64, [1.0] * 54 + [-1.0] * 10, [-1.0] * 64]
    rows = [(i, vectors[0]) for i in range(3000)] + [(5000, vectors[1]), (5001, vectors[2]), (5002, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    met = []
    before, Q.components = Q.components, lambda edges: met.append(edges.count()) or before(edges)
    try:
        found = {r["node"]: (r["label"], r["members"]) for r in catalog.QUERIES["near_components"](spark, str(tmp_path)).collect()}
    finally:
        Q.components = before
    assert met == [3000] and found == {i: (0, 3001) for i in (*range(3000), 5000)} | {5001: (5001, 1), 5002: (5002, 1)}


def test_perceptual_hash_of_shifted_brightness():
    picture = np.random.default_rng(1).normal(100, 20, (32, 32))
    assert D.perceptual_hash(picture) == D.perceptual_hash(picture + 20) and 0 <= D.perceptual_hash(picture) < 2**64


def test_components(spark):
    label = {r["node"]: r["label"] for r in components(spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("z", "z"), (None, "a")], "a string, b string")).collect()}
    assert label == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_screen(spark):
    part = lambda rows: spark.createDataFrame(rows, "sha string, code long")
    rows = spark.createDataFrame([("1", 1, "p", 0), ("2", 2, "q", 0b11), ("3", 3, "t", 255 << 40), ("4", 4, "n", 255 << 40), ("5", 5, "n", 255 << 40), ("6", 6, "far", -1), ("7", 7, None, None)], "sample_id string, ord long, sha string, code long")
    got = {r["sample_id"]: r["screen"] for r in D.screened(rows, part([("p", 0), ("z", 0b1)]), part([("t", (255 << 40) | 1)])).collect()}
    assert got == {"1": "protected_exact", "2": "protected_near", "3": "train_exact", "4": "train_near", "5": "train_exact", "6": "kept", "7": "kept"}


def screen_by_hand(rows, protected, train, threshold=4):
    """One row after the other, as the reference has it."""
    near = lambda c, codes: c is not None and any(d is not None and bin((c ^ d) & (2**64 - 1)).count("1") <= threshold for d in codes)
    shas, codes, out = {s for s, _ in train if s is not None}, [c for _, c in train], {}
    for i, _, sha, code in sorted(rows, key=lambda r: (r[1], r[0])):
        if sha is not None and sha in {s for s, _ in protected}:
            out[i] = "protected_exact"
        elif near(code, [c for _, c in protected]):
            out[i] = "protected_near"
        elif sha in shas:
            out[i] = "train_exact"
        else:
            out[i] = "train_near" if near(code, codes) else "kept"
            codes.append(code)
            shas |= {sha} - {None}
    return out


def test_screen_grows_by_earlier_rows(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(63) for _ in range(12)]

    def some(n):
        made = []
        for _ in range(n):
            code = rng.choice(centres)
            for _ in range(rng.randint(0, 3)):
                code ^= 1 << rng.randint(0, 62)
            made.append((None if rng.random() < 0.05 else f"s{code}", None if rng.random() < 0.05 else code))
        return made

    protected, train, incoming = some(3), some(3), some(150)
    rows = [(f"{i:03d}", rng.randint(0, 120), *r) for i, r in enumerate(incoming)]
    part = lambda x: spark.createDataFrame(x, "sha string, code long")
    got = {r["sample_id"]: r["screen"] for r in D.screened(spark.createDataFrame(rows, "sample_id string, ord long, sha string, code long"), part(protected), part(train)).collect()}
    want = screen_by_hand(rows, protected, train)
    assert got == want and set(want.values()) == {"protected_exact", "protected_near", "train_exact", "train_near", "kept"}
    two = spark.createDataFrame([("1", 1, "a", 0b1), ("2", 2, "b", 0b11)], "sample_id string, ord long, sha string, code long")
    assert {r["sample_id"]: r["screen"] for r in D.screened(two, part([]), part([])).collect()} == {"1": "kept", "2": "train_near"}


def test_screen_of_documents_by_hand(spark, sf):
    docs = Q.hashed(spark, sf).join(Q.simhash(spark, sf).withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", "source", "sha", "code").collect()
    part = lambda s: [(r["sha"], r["code"]) for r in docs if r["source"] == s]
    rows = [(r["doc_id"], r["doc_id"], r["sha"], r["code"]) for r in docs if r["source"] not in ("src0", "src1")]
    want = screen_by_hand(rows, part("src0"), part("src1"))
    assert {r["doc_id"]: r["screen"] for r in Q.training_screen_near(spark, sf).collect()} == want and "train_near" in want.values()


def test_whole_passages(spark):
    passage = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "Before. " + passage.upper().replace(" ", ",  ") + "! After"), (2, passage[:100]), (3, "tiny Phrase"), (4, None), (5, "xtiny phrase"), (None, passage)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, passage), (8, "Tiny, phrase"), (9, ""), (10, None)], "item_id long, text string")
    assert {tuple(r) for r in Q.whole_passages(docs, bench).collect()} == {(1, 1, 7, "7"), (3, 1, 8, "8"), (None, 1, 7, "7")}


def split_frame(spark, n=30):
    rows = [(f"SAMPLE_{i}", f"GROUP_{min(i, n - 1) if i < n else 0}", f"D{i % 5}", f"s{i % 3}", "adult" if i % 2 else None) for i in range(n + 1)]
    return spark.createDataFrame(rows, "sample_id string, leakage_group_id string, disease_id string, dataset_id string, age string")


def test_greedy_split(spark):
    frame = split_frame(spark)
    ratios = {"train": 0.6, "validation": 0.2, "test": 0.2}
    run = lambda f: {r[0]: r[1] for r in C.greedy_split(C.group_features(f, "leakage_group_id", {"disease": F.col("disease_id"), "dataset": F.col("dataset_id")}, {"age": F.col("age")}), "leakage_group_id", ratios, 42, block=200_000).collect()}
    got = run(frame)
    assert len(got) == 30 and Counter(got.values()) == {"train": 18, "validation": 6, "test": 6} and run(frame.orderBy(F.rand(3)).repartition(7)) == got


def many_groups(n=500):
    """Groups with common, rare and no features, one of them null and some past what a double holds."""
    rng = random.Random(4)
    keys = [None, *(2**53 + 1 + i for i in range(n - 1))]
    some = lambda: [(f"primary:a:{x}", 1.0) for x in sorted(rng.sample(range(9), rng.randint(1, 4)))] + [(f"secondary:b:{x}", 0.25) for x in sorted(rng.sample(range(4), rng.randint(0, 2)))]
    return [(k, [] if i == 7 else [("primary:rare:x", 1.0), *some()] if i % 100 < 2 else some()) for i, k in enumerate(keys)]


def test_greedy_split_is_one_assignment_in_any_blocks(spark):
    """Blocks go on where the one before ended: no block has targets and capacities of its own."""
    rows, ratios = many_groups(), {"train": 0.7, "validation": 0.1, "test": 0.2}
    want = C.greedy_assignment([(None if g is None else str(g), f) for g, f in rows], ratios, 42)
    frame = spark.createDataFrame(rows, "id long, features array<struct<feature: string, weight: double>>")
    for block in (1000, 90):
        got = [(r["id"], r["split"]) for r in C.greedy_split(frame.repartition(5), "id", ratios, 42, block=block).collect()]
        assert len(got) == 500 and {None if g is None else str(g): s for g, s in got} == want
    assert Counter(want.values()) == C.capacities(500, ratios)
    assert C.greedy_split(frame.limit(0), "id", ratios, 42, block=90).collect() == []
    named = C.group_features(frame, "id", {"a": F.lit("b:x"), "a:b": F.lit("x")}, {}).first()["features"]
    assert [tuple(x) for x in named] == [("primary:a:b:x", 1.0)]


def test_greedy_split_holds_a_batch(spark):
    """The splits of a batch leave before the next batch is read, and a task's memory doesn't grow with its groups."""
    ratios, taken = {"train": 0.5, "test": 0.5}, []
    known = C.Features(["primary:a:x"], [4000], [(0, 1.0)])

    def batches():
        for i in range(40):
            taken.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(range(i * 100, i * 100 + 100)), pa.array([str(x) for x in range(i * 100, i * 100 + 100)]), pa.array([[0]] * 100, pa.list_(pa.int32()))], ["group", "text", "pairs"])

    room, seen = [2000, 2000], 0
    for out in known.assigned(batches(), ratios, 1, room, [[0.0], [0.0]]):
        seen += len(out)
        assert len(out) == 1 or seen == 100 * len(taken)
    assert seen == 4001 and out.column("state").to_pylist() == ["[[0, 0], [[2000.0], [2000.0]]]"]


def test_capacities_break_ties_as_sql_does(spark, tmp_path):
    """2 * 0.7 and 2 * 0.2 both leave 0.4, which binary numbers tell apart; sf0.001 itself has no such tie."""
    for total, sizes in ((2, (2, 0, 0)), (5, (4, 0, 1)), (8, (6, 1, 1)), (25, (18, 2, 5)), (899942, (629960, 89994, 179988))):
        assert tuple(C.capacities(total, {"train": 0.7, "validation": 0.1, "test": 0.2}).values()) == sizes
    for t in TABLES:
        if t != "orders":
            (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    some = [r[0] for r in orders.select("o_custkey").distinct().orderBy("o_custkey").limit(12).collect()]
    orders.where(F.col("o_custkey").isin(some)).write.parquet(str(tmp_path / "orders.parquet"))
    assert got(catalog.QUERIES["split_capacities"](spark, str(tmp_path))) == expected(catalog.ORACLES["split_capacities"], str(tmp_path))


def test_capacities_quotas_and_fills(spark):
    assert C.capacities(11, {"a": 0.5, "b": 0.25, "c": 0.25}) == {"a": 5, "b": 3, "c": 3}
    with pytest.raises(ValueError):
        C.capacities(5, {"a": 0.5, "b": 0.4})
    weights = spark.createDataFrame([("a", 10), ("b", 5), ("c", 1)], "k string, n long")
    assert {r["k"]: r["quota"] for r in C.apportioned(weights, "k", "n", 20, least=2).collect()} == {"a": 11, "b": 6, "c": 3}
    assert C.water_filled({"a": 2, "b": 9, "c": 9}, 10, 5) == {"a": 2, "b": 4, "c": 4}
    assert C.proportional_fill({"a": 8, "b": 2}, {}, 5) == ["a", "a", "b", "a", "a"]


def test_exact_subset_and_matching():
    sizes = {f"g{i}": 3 + i % 4 for i in range(20)}
    chosen = C.exact_subset(sizes, 31, 42)
    assert sum(sizes[g] for g in chosen) == 31 and C.exact_subset(dict(reversed(sizes.items())), 31, 42) == chosen
    with pytest.raises(ValueError):
        C.exact_subset({"a": 4}, 3, 42)
    assert C.matching({"p": ["x", "y"], "q": ["x"], "r": ["x", "z"]}) == {"p": "y", "q": "x", "r": "z"}


def test_matched_donors(spark):
    rows = [(i, f"L{i % 4}") for i in range(40)] + [(100 + i, "L0") for i in range(5)]
    got = C.matched(spark.createDataFrame(rows, "id long, label string"), "id", "label", 1).collect()
    label = dict(rows)
    assert len(got) == 45 and len({r["donor"] for r in got}) == 45 and all(label[r["id"]] != label[r["donor"]] for r in got)


def test_selection_is_stable(spark):
    frame = spark.createDataFrame([(f"P{i // 2}", f"T{i}") for i in range(10)], "pair_id string, task_id string")
    pick = lambda f: [r["task_id"] for r in C.select_units(f, "pair_id", "task_id", 2, 42, "r").collect()]
    assert len(pick(frame)) == 4 and pick(frame.orderBy(F.rand(1))) == pick(frame)


def test_balanced_order_is_nested(spark):
    units = spark.createDataFrame([(f"u{i}", f"s{i % 3}", f"d{i % 2}") for i in range(60)], "unit string, stratum string, source string")
    own = C.balanced_order(units, "unit", "stratum", "source", 42, "r").orderBy("turn_of_stratum", "stratum_key").collect()
    for n in (6, 12, 30):
        assert set(Counter(r["stratum"] for r in own[:n]).values()) == {n // 3} and set(Counter(r["source"] for r in own[:n]).values()) == {n // 2}


def test_distractors_and_pairs(spark):
    frame = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(31)], "id long, label string")
    used = Counter((r["label"], d) for r in C.distractors(frame, "id", "label", 1).collect() for d in r["distractors"])
    for x in "abc":
        own = [n for (label, _), n in used.items() if label == x]
        assert max(own) - min(own) <= 1
    tasks = C.paired_tasks(frame, "id", "label", 1, 1).collect()
    assert len(tasks) == 60 and Counter(r["difficulty"] for r in tasks) == {"low": 30, "high": 30} and all(r["label"] in r["candidates"] and len(set(r["candidates"])) == (2 if r["difficulty"] == "low" else 3) for r in tasks)


def test_hash_split(spark):
    ids = spark.range(4000).select(C.hash_split("id", {"a": 0.5, "b": 0.3, "c": 0.2}, 1).alias("s"))
    n = {r["s"]: r["count"] for r in ids.groupBy("s").count().collect()}
    assert abs(n["a"] - 2000) < 150 and abs(n["b"] - 1200) < 150 and abs(n["c"] - 800) < 150


def test_statistics(spark):
    row = one(spark, *stats.wilson(F.lit(8), F.lit(10)), *stats.wilson(F.lit(0), F.lit(0)), stats.ratio(F.lit(1), F.lit(0)), stats.fraction(F.lit(1), F.lit(0)), stats.f1(F.lit(1), F.lit(1), F.lit(1)))
    assert row[0] == pytest.approx(0.4901625, abs=1e-6) and row[1] == pytest.approx(0.9433178, abs=1e-6) and list(row)[2:] == [0, 0, 0, None, 0.5]
    assert stats.bootstrap_interval(np.array([1.0]), 10, 1, 0.95) == (1.0, 1.0)
    low, high = stats.bootstrap_interval(np.arange(100.0), 500, 42, 0.95)
    assert low < 49.5 < high and (low, high) == stats.bootstrap_interval(np.arange(100.0), 500, 42, 0.95)
    frame = spark.createDataFrame([(9, 1), (0, 0), (5, 5)], "a int, b int").select(stats.mcnemar("a", "b").alias("p"))
    assert [r["p"] for r in frame.collect()] == [pytest.approx(0.021484375), 1.0, 1.0]
    empty, some = F.array().cast("array<string>"), F.array(F.lit("a"), F.lit("b"))
    assert list(one(spark, *stats.set_scores(empty, empty), *stats.set_scores(some, empty), *stats.set_scores(some, F.array(F.lit("a"))))) == [1, 1, 1, 0, 0, 0, 0.5, 1, pytest.approx(2 / 3)]


def test_mcnemar_of_many_pairs():
    """As whole numbers say, to the last digit; 90,000 changed pairs are 45,000 sums of numbers of 90,000 bits that way."""
    whole = lambda a, b: min(1.0, 2 * sum(comb(a + b, i) for i in range(min(a, b) + 1)) / 2 ** (a + b))
    for a, b in ((0, 0), (0, 3), (15, 74), (7, 8), (500, 501), (499, 502), (470, 540), (900, 1100), (30, 1500), (0, 1060), (0, 1074), (1, 1090), (0, 3000), (1500, 1400)):
        assert stats.mcnemar_p(a, b) == stats.mcnemar_p(b, a) == whole(a, b)
    began = time.process_time()
    for n in (45_000, 10**6, 10**9):
        z = (2 * round(n**0.5) - 1) / (2 * n) ** 0.5  # with the correction for continuity: n - sqrt(n) against n + sqrt(n)
        assert stats.mcnemar_p(n - round(n**0.5), n + round(n**0.5)) == pytest.approx(erfc(z / 2**0.5), rel=20 / n)
    assert time.process_time() - began < 5


def test_ranking_and_calibration(spark):
    frame = spark.createDataFrame([("g", "a", ["a", "b"]), ("g", "b", ["a", "b"]), ("g", "c", ["a", "b"])], "g string, truth string, ranked array<string>")
    assert tuple(M.ranking_metrics(frame, ["g"], "truth", "ranked", (1, 2)).first()) == ("g", 3, 0.333333, 0.666667, 0.5)
    counts = M.label_counts(frame.withColumn("top", F.element_at("ranked", 1)), spark.createDataFrame([("a",), ("z",)], "l string"), "l", "truth", "top")
    assert {r["l"]: (r["tp"], r["fp"], r["fn"]) for r in counts.collect()} == {"a": (1, 2, 0), "z": (0, 0, 0)} and M.macro_f1(counts).first()["macro_f1"] == 0.25
    shares = spark.createDataFrame([(0.9, 1), (0.2, 1), (1.0, 0), (float("nan"), 1), (1.5, 1)], "c double, h int")
    row = M.calibration(shares, "c", "h").first()
    assert row["n"] == 3 and row["ece"] == pytest.approx((0.45 * 2 + 0.8) / 3, abs=1e-6) and row["brier"] == pytest.approx((0.01 + 0.64 + 1) / 3, abs=1e-6)


def test_pairs_fairness_votes(spark):
    frame = spark.createDataFrame([("p", "low", 1), ("p", "high", 0), ("q", "low", 1), ("r", "low", 1), ("r", "low", 0), ("r", "high", 1)], "pair string, c string, v int")
    got = {r["pair"]: r for r in M.paired(frame, "pair", "c", "v", ("low", "high")).collect()}
    assert got["p"]["complete"] and (got["p"]["low"], got["p"]["high"]) == (1, 0) and not got["q"]["complete"] and not got["r"]["complete"]
    groups = lambda rows: M.fairness(spark.createDataFrame(rows, "g string, a double"), "g", "a").first()["fairness"]
    assert groups([("x", 0.8), ("y", 0.4), ("unknown", 0.0)]) == 0.5 and groups([("x", 0.8)]) == 1 and groups([("x", 0.0), ("y", 0.0)]) == 0
    votes = spark.createDataFrame([("3",), ("x",), (None,)], "v string").select(M.mean_vote(F.col("v"))).first()[0]
    assert votes == 1.0


GOOD = '{"predictions": [{"rank": 1, "disease_id": "a"}, {"rank": 2, "disease_id": "b"}]}'


@pytest.mark.parametrize(("text", "schema", "canonical", "errors"), [
    (GOOD, True, True, []),
    (f"```json\n{GOOD}\n```", False, True, ["invalid_json:wrapped_in_single_json_fence"]),
    ('{"predictions": ["a", "b"]}', False, True, None),
    ('["a", "b"]', False, False, None),
    (f"Sure: {GOOD}", False, False, None),
    (GOOD.replace('"b"', '"a"'), False, False, ["disease_ids_must_be_unique"]),
    (GOOD.replace("2", "true"), False, False, ["prediction_1_rank_invalid", "ranks_must_be_consecutive"]),
    (GOOD.replace('"b"', '"zz"'), False, False, ["prediction_1_disease_id_unknown"]),
    (None, False, False, None), ("", False, False, None), ("[" * 5000, False, False, None),
])
def test_ranked_contract(text, schema, canonical, errors):
    got = P.check_ranked(text, {"a", "b"}, 2)
    assert got[2] == schema and got[4] == canonical and (errors is None or got[3] == errors) and (got[6] == ["a", "b"]) == canonical


EVIDENCE = '{"findings": [{"finding_id": "F1", "concept_id": "papule", "confidence": 0.9}], "clinical_description": "a papule", "differential": [{"rank": 1, "disease_id": "a", "confidence": 0.8, "supporting_finding_ids": ["F1"]}], "case_confidence": "high"}'


@pytest.mark.parametrize(("old", "new", "shape", "agrees"), [
    ("", "", [], []),
    ('"F1", "concept_id"', '"F2", "concept_id"', [], ["finding_ids_must_be_consecutive", "supporting_finding_id_must_resolve"]),
    ("0.8", "0.5", [], ["case_confidence_must_match_top_confidence"]),
    ("0.8", "true", ["differential_0_confidence_invalid"], []),
    ('"papule"', '"nodule"', ["finding_0_concept_id_unknown"], ["description_concepts_must_be_declared_findings"]),
    ('["F1"]', "[]", ["differential_0_supporting_finding_count_invalid"], ["every_diagnosis_must_cite_evidence"]),
    ('"a papule"', '" "', [], ["clinical_description_must_not_be_blank"]),
    ('"high"}', '"high", "x": 1}', ["root_fields_invalid"], []),
    ('"a"', '"zz"', ["differential_0_disease_id_unknown"], []),
    ('"rank": 1', '"rank": 2', ["differential_0_rank_invalid"], ["ranks_must_be_consecutive"]),
    ('"a papule"', "7", ["clinical_description_must_be_string"], ["clinical_description_must_not_be_blank"]),
    ("0.9", "NaN", None, []),
])
def test_evidence_contract(old, new, shape, agrees):
    text = EVIDENCE.replace(old, new) if old else EVIDENCE
    raw, schema, semantic, wrong, contradicts = P.check_evidence(text, {"a"}, {"papule"}, 1, lambda t: P.concepts_in(t, {"papule": ["papule"]}), lambda t: False)
    if shape is None:
        assert not raw
    else:
        assert raw and wrong == shape and contradicts == agrees and schema == (not shape) and semantic == (not agrees)
        fenced = P.check_evidence(f"```json\n{text}\n```", {"a"}, {"papule"}, 1, lambda t: P.concepts_in(t, {"papule": ["papule"]}), lambda t: False)
        assert fenced == (False, schema, semantic, wrong, contradicts)


def test_evidence_that_is_no_object():
    check = lambda text: P.check_evidence(text, set(), set(), 1, lambda t: set(), lambda t: False)
    assert check("[1]") == (True, False, False, ["root_must_be_object"], []) and check("```json\n[1]\n```")[3] == ["invalid_json:wrapped_in_single_json_fence", "root_must_be_object"]
    assert check("nonsense")[:3] == (False, False, False) and check(None)[3] == ["invalid_json:null"]


WORDS = {"erythema": ["erythematous"], "plaque": ["plaque"], "scale": ["scale"], "yellow": ["yellow"], "white_hypopigmentation": ["white"], "salmon": ["salmon"], "macule": ["macule"]}


@pytest.mark.parametrize(("text", "concepts"), [
    ("A salmon-pink erythematous macule is partially obscured by a white measuring device.", {"salmon", "erythema", "macule"}),
    ("An erythematous plaque with scale and yellow crust.", {"erythema", "plaque", "scale", "yellow"}),
    ("An erythematous plaque with adherent white scale.", {"erythema", "plaque", "scale"}),
    ("An erythematous plaque without scale.", {"erythema", "plaque"}),
    ("A plaque, not raised or thick, with scale", {"plaque", "scale"}),
    ("A white ruler beside the plaque", {"plaque"}), ("white patch of skin", {"white_hypopigmentation"}), ("a yellow sky", set()), ("", set()),
])
def test_concepts_negation_and_colours(text, concepts):
    assert P.concepts_in(text, WORDS) == concepts


def test_flat_contract_and_expressions(spark):
    fields = {"status": lambda x: x in ("answered", "abstained"), "predictions": lambda x: isinstance(x, list) and len(x) <= 3}
    relations = {"abstained_without_predictions": lambda v: v["status"] != "abstained" or not v["predictions"]}
    check = lambda t: P.check_fields(t, fields, relations)
    rows = ['{"status": "answered", "predictions": []}', '{"status": "abstained", "predictions": [1]}', '{"status": "no"}', '{"status": "answered", "predictions": [], "x": 1}', '{"status": "answered", "status": "answered", "predictions": []}', None]
    frame = spark.createDataFrame([(r,) for r in rows], "t string").select(P.checked("t", check).alias("c")).select("c.*").collect()
    assert [(r["schema_valid"], r["semantic_valid"]) for r in frame] == [(True, True), (True, False), (False, False), (False, False), (False, False), (False, False)]
    assert frame[2]["schema_errors"] == ["missing_predictions", "status_invalid"] and frame[3]["schema_errors"] == ["unexpected_x"]
    text = F.lit("<think> why </think>B) it is")
    row = one(spark, P.separated(text), P.mcq_choice(P.separated(text)["final"], "AB"), P.tag_block(F.lit("<A>\n x </a>"), "a"), P.ordered_tags(F.lit("<a>1</a><b>2</b>"), ["b", "a"]), P.band(F.lit(0.4)), P.terms_in(F.lit("An  all rights\nreserved x"), {"r": ["all rights reserved"], "t": ["token"]}))
    assert tuple(row[0]) == ("why", "B) it is") and tuple(row[1]) == ("B", "leading_choice_letter", False) and row[2] == "x" and row[3] is False and row[4] == "moderate" and row[5] == ["r"]


def test_lexicon():
    lexicon = {"papule": ["papule", "papules"], "ulcer": ["ulcer"], "two": ["red patch"]}
    assert P.concepts_in("Several papules, no ulcer. Red  patch", lexicon) == {"papule", "two"} and P.concepts_in("papuleX", lexicon) == set()


def test_report_operators(spark):
    frame = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", None)], "k string, c string, v int")
    assert {r["k"]: r["n"] for r in R.with_total(frame, "k", "all", F.count("*").alias("n")).collect()} == {"a": 2, "b": 1, "all": 3}
    assert {r["rule"]: r["violations"] for r in R.checks(frame, {"told": F.col("v") > 0, "k": F.col("k") != "z"}).unionByName(R.unique(frame, "k")).collect()} == {"told": 1, "k": 0, "unique_k": 1}
    assert {tuple(r) for r in R.histogram(frame, "c", ["x", "z"]).collect()} == {("x", 2), ("z", 0), ("total", 3)}
    assert {tuple(r) for r in R.crosstab(frame, "k", "c", ["x", "y"]).collect()} == {("a", 1, 1, 2), ("b", 1, 0, 1)}
    assert pd.DataFrame(R.balance(frame, frame.where("k = 'a'"), ["c"]).collect()).shape == (2, 6)
    status, reasons = R.support(F.lit(20), F.lit(1), 100, 2)
    assert list(one(spark, status, reasons, *R.support(F.lit(100), F.lit(2), 100, 2))) == ["unsupported", "insufficient_groups;insufficient_datasets", "supported", None]


def test_matching_by_long_paths():
    """Each wants its own number and the next, in an order that makes every new one push all before it on."""
    n = 5000
    wishes = {str(i): [str(i + 1), str(i)] for i in range(n)}
    wishes = dict(reversed(wishes.items())) | {"last": [str(n)]}
    got = C.matching(wishes)
    assert len(got) == n + 1 and len(set(got.values())) == n + 1 and all(got[w] in wishes[w] for w in wishes)
    assert C.matching({"a": ["x"], "b": ["x"]}) in ({"a": "x"}, {"b": "x"}) and C.matching({"a": ["x", "y"], "b": ["x"]}) == {"a": "y", "b": "x"}


def test_places_within_labels(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, "x"])) for i in range(3000)]
    frame = spark.createDataFrame(rows, "i long, label string, other string")
    want = {}
    for i, label, other in sorted(rows, key=lambda r: C.hashed(1, r[0])):
        want.setdefault((label, other), []).append(i)
    for limit in (C.BROADCAST_RUNS, 0):
        monkeypatch.setattr(C, "BROADCAST_RUNS", limit)
        out = C.placed(frame, ["label", "other"], [D.S.digest(1, "i"), F.col("i")], "place")
        got = {(r["label"], r["other"], r["place"]): r["i"] for r in out.collect()}
        assert out.columns == ["i", "label", "other", "place"] and got == {(*k, n): i for k, own in want.items() for n, i in enumerate(own, 1)}
    assert C.placed(frame.limit(0), ["label"], [F.col("i")], "place").count() == 0


def test_benchmark_without_trained_images(spark):
    from cambium.operators import audits

    images = spark.createDataFrame([("f17k/AB.jpg", "h1"), ("scin/c.png", "h2"), ("pad/PAT_9_1.png", "h3"), ("isic/I1.jpg", "h4"), ("isic/I2.jpg", "h5"), ("f17k/none", None), (".x", "h6")], "image string, image_sha256 string")
    train = spark.createDataFrame([("h5", "s", "q", "g"), ("x", "fitzpatrick17k_c", "ab", "g2"), ("y", "s", "c.png", "SCIN_CASE_1"), ("z", "pad_ufes_20", "pat_9_1.PNG", "PAD_UFES_20_PATIENT_PAT_9"), (None, "s", None, "HIBA_PATIENT_3")], "image_sha256 string, source string, source_image_id string, leakage_group_id string")
    case = F.when(audits.name(F.col("image")) == "c.png", "SCIN_CASE_1")
    patient = F.when(audits.stem(F.col("image")) == "I1", "HIBA_PATIENT_3")
    audit = audits.image_audit(images, train, audits.skin_rules(F.col("image"), case, patient))
    got = {r["image"]: r["reasons"] for r in audit.collect()}
    assert got == {"f17k/AB.jpg": ["fitzpatrick17k_c_source_image_id"], "scin/c.png": ["scin_case_group"], "pad/PAT_9_1.png": ["pad_ufes_20_patient_group", "pad_ufes_20_source_image_id"], "isic/I1.jpg": ["hiba_patient_group"], "isic/I2.jpg": ["exact_image_sha256"], "f17k/none": [], ".x": []}
    tasks = spark.createDataFrame([("a.json", "1", "f17k/AB.jpg"), ("a.json", "2", ".x"), ("a.json", "2", ".x"), ("a.json", None, "f17k/none"), ("b.json", "1", "isic/I1.jpg")], "file string, task_id string, image string")
    kept, gone, record = audits.without(tasks, audit)
    assert {tuple(r) for r in record.collect()} == {("a.json", 4, 1, 3, 1), ("b.json", 1, 1, 0, 0)} and kept.count() == 3 and gone.count() == 2
    assert audits.filtered_faults(kept, gone, record) == []
    assert audits.filtered_faults(tasks, gone, record) == ["a.json: counts", "b.json: counts", "a.json: excluded task remains", "b.json: excluded task remains"]
    with pytest.raises(ValueError, match="audited"):
        audits.without(tasks, audit.where("image <> '.x'"))
