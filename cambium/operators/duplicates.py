"""Exact, near and lineage duplicates of samples: edges, groups, canonical choice, leakage groups and their reports.

A frame of samples has sample_id, dataset_id, group_id, disease_id, diagnosis_basis, include, exclusion_reason, image_sha256, perceptual_hash (long)
and lineage (array of tokens). Edges are (a, b, kind) with a < b.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cambium.functions import scalars as S
from cambium.operators.graph import components
from cambium.scratch import written

# Which evidence for a label comes first.
EVIDENCE = ("pathology", "clinical_consensus", "dermatologist_review", "dermatologist_differential", "atlas_label", "self_reported", "derived", "unknown")


@dataclass(frozen=True)
class Policy:
    """threshold: differing bits of near duplicates; contributors and external: datasets by role, in order of preference."""

    threshold: int = 4
    contributors: tuple[str, ...] = ()
    external: tuple[str, ...] = ()

    @property
    def order(self) -> dict[str, int]:
        return {d: i for i, d in enumerate((*self.contributors, *self.external))}


def rank_in(values: Sequence[str], c: Column) -> Column:
    """Place of a value in an order; 999 for others."""
    if not values:
        return F.lit(999)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ((v, i) for i, v in enumerate(values)) for x in pair]), c), F.lit(999))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def hash_of_hex(c: Column | str) -> Column:
    """The signed long of 16 hex digits."""
    return F.conv(S.col(c), 16, -10).cast("long")


def blocks(bits: int, n: int) -> list[tuple[int, int]]:
    """(shift, width) of n blocks that make up a code."""
    edges = [bits * i // n for i in range(n + 1)]
    return [(edges[i], edges[i + 1] - edges[i]) for i in range(n)]


def agreeing(bits: int, threshold: int, rows: int) -> int:
    """How many of threshold + r blocks codes within threshold are made to agree in, r: that with the least work for so many codes, keys made and pairs expected to meet. At most 2,000 keys a code."""
    work = {r: (n := comb(threshold + r, r)) * (rows + rows * rows / 2 ** (r * bits / (threshold + r) + 1)) for r in range(1, 5) if comb(threshold + r, r) <= 2000}
    return min(work, key=work.__getitem__)


def selective(bits: int, threshold: int, r: int) -> bool:
    """Whether keys of r of threshold + r blocks let less than a tenth of all pairs meet. If not, holding all with all in blocks is less work than making codes meet."""
    return comb(threshold + r, r) / 2 ** (r * bits / (threshold + r)) < 0.1


def _within(x: np.ndarray, y: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in x and y, and distances, of all pairs of codes within threshold, some rows of x at a time."""
    met = np.zeros((32, -(-len(y) // 8) * 8), bool)
    for at in range(0, len(x), 32):
        part = x[at : at + 32]
        distance = np.bitwise_count(part[:, None] ^ y)
        np.less_equal(distance, threshold, out=met[: len(part), : len(y)])
        words = np.flatnonzero(met[: len(part)].reshape(-1).view(np.uint64))  # eight pairs at a time, as few have any
        found = (words[:, None] * 8 + np.arange(8)).reshape(-1)
        found = found[met.reshape(-1)[found]]
        i, j = np.divmod(found, met.shape[1])
        yield at + i, j, distance[i, j]


def held_against_all(distinct: DataFrame, rows: int, threshold: int, block: int = 8192) -> DataFrame:
    """(code) to (p, q, distance) for all pairs within threshold, each once: codes are dealt into blocks of about block, and a task holds two of them against each other at a time.
    That is rows squared over two comparisons, of some nanoseconds; a block is sent to as many tasks as there are blocks."""
    n = max(1, -(-rows // block))
    dealt = distinct.groupBy(F.pmod(F.xxhash64("code"), F.lit(n)).cast("long").alias("block")).agg(F.collect_list("code").alias("codes"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda other: F.least("block", other) * n + F.greatest("block", other)))
    pairs = n * (n + 1) // 2
    sent = written(dealt, "blocks").select("codes", pair.alias("pair")).repartition(max(min(pairs, 200), pairs // 16), "pair")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [(p.as_py(), c.values.to_numpy().view(np.uint64)) for b in batches for c, p in zip(b.column("codes"), b.column("pair"), strict=True)]
        (which, x), (_, y) = sides[0], sides[-1]
        alone = which // n == which % n
        for i, j, distance in _within(x, y, threshold) if alone or len(sides) == 2 else ():
            if alone:
                i, j, distance = i[i < j], j[i < j], distance[i < j]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(x[i].view(np.int64)), pa.array(y[j].view(np.int64)), pa.array(distance.astype(np.int32))], names=["p", "q", "distance"])

    return sent.groupBy("pair").applyInArrow(one, "p long, q long, distance int")


def _low(width: int) -> int:
    """A long whose width lowest bits are set."""
    return -1 if width == 64 else (1 << width) - 1


def near_pairs(codes: DataFrame, threshold: int, code: str = "code", bits: int = 64) -> DataFrame:
    """(id, code) to (a, b, distance) for all a < b within threshold bits, without comparing all with all. Of threshold + r blocks of a code those within threshold agree
    in r at least, by the pigeonhole principle: codes meet by each r of their blocks. r follows the number of codes, so that keys get longer as codes get more.
    Equal codes are compared once: pairs are found between distinct codes, and then given to their ids.

    A pair that agrees in more blocks is taken by the first r of them. Null codes have no pairs. Where the threshold is so wide that no such keys are selective, all distinct
    codes are held against all (held_against_all).
    """
    own = written(codes.where(F.col(code).isNotNull()).select("id", code), "coded")
    distinct = written(own.select(F.col(code).alias("code")).distinct(), "codes")
    rows = distinct.count()
    r = agreeing(bits, threshold, rows)
    apart = _met_by_blocks(distinct, threshold, bits, r) if selective(bits, threshold, r) else held_against_all(distinct, rows, threshold)
    left, right = own.select(F.col("id").alias("i"), F.col(code).alias("p")), own.select(F.col("id").alias("j"), F.col(code).alias("q"))
    # found pairs, whose number Spark can't tell, are never broadcast
    unequal = apart.hint("shuffle_merge").join(left, "p").join(right, "q").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "distance")
    equal = left.join(right, (F.col("p") == F.col("q")) & (F.col("i") < F.col("j"))).select(F.col("i").alias("a"), F.col("j").alias("b"), F.lit(0).alias("distance"))
    return unequal.unionByName(equal)


def _met_by_blocks(distinct: DataFrame, threshold: int, bits: int, r: int) -> DataFrame:
    """(code) to (p, q, distance): the distinct codes within threshold, by all keys of r of threshold + r blocks."""
    parts = blocks(bits, threshold + r)
    kept = [sum(1 << i for i in own_) for own_ in combinations(range(len(parts)), r)]
    wide = {m: reduce(int.__or__, (_low(w) << at for i, (at, w) in enumerate(parts) if m >> i & 1)) for m in kept}
    signed = lambda x: (x & (2**64 - 1)) - (x >> 63 & 1) * 2**64
    masks = F.lit(",".join(f"{m}:{signed(wide[m])}" for m in kept))
    placed = distinct.select("code", F.explode(F.split(masks, ",")).alias("m")).select("code", F.substring_index("m", ":", 1).cast("int").alias("blocks"), F.col("code").bitwiseAND(F.substring_index("m", ":", -1).cast("long")).alias("part"))
    x, y = placed.alias("x"), placed.alias("y")
    same = (F.col("x.blocks") == F.col("y.blocks")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.code") < F.col("y.code"))
    distance = hamming(F.col("x.code"), F.col("y.code"))
    diff = F.col("x.code").bitwiseXOR(F.col("y.code"))
    # blocks that agree, before the last of those met by, all belong to them
    agree = reduce(lambda a, b: a + b, (F.when(diff.bitwiseAND(F.lit(signed(_low(w) << at))) == 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, (at, w) in enumerate(parts)))
    upto = reduce(lambda a, i: a.bitwiseOR(F.shiftright(a, i)), (1, 2, 4, 8, 16), F.col("x.blocks"))
    first = agree.bitwiseAND(upto) == F.col("x.blocks")
    # a key for each code and choice of blocks: many times the table that Spark judges by, so neither side is broadcast
    return x.hint("shuffle_merge").join(y, same & (distance <= threshold) & first).select(F.col("x.code").alias("p"), F.col("y.code").alias("q"), distance.alias("distance"))


def star(frame: DataFrame, key: Column, kind: str) -> DataFrame:
    """Edges from the first sample of each key to its others: what links a group without naming all its pairs. Null keys link nothing."""
    rows = frame.select("sample_id", key.alias("key")).where("key is not null").distinct()
    first = rows.groupBy("key").agg(F.min("sample_id").alias("a"), F.max("sample_id").alias("z")).where("a <> z").select("key", "a")
    first = written(first, "first")  # read from a table, the join can be split where a key has very many rows
    return rows.join(first, "key").where("a <> sample_id").select("a", F.col("sample_id").alias("b"), F.lit(kind).alias("kind"))


def all_pairs(frame: DataFrame, key: Column, kind: str) -> DataFrame:
    """All edges within each key; for reports on pairs, whose size is that of their result."""
    rows = frame.select("sample_id", key.alias("key")).where("key is not null").distinct()
    x, y = rows.alias("x"), rows.alias("y")
    return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.sample_id") < F.col("y.sample_id"))).select(F.col("x.sample_id").alias("a"), F.col("y.sample_id").alias("b"), F.lit(kind).alias("kind"))


def evidence(frame: DataFrame, policy: Policy, rejected: DataFrame | None = None) -> DataFrame:
    """(a, b, kinds, distance): all pairs with their kinds of evidence, sorted. Near pairs skip equal images; rejected (a, b) lose their near evidence."""
    exact = all_pairs(frame, F.col("image_sha256"), "exact")
    near = near_pairs(frame.select(F.col("sample_id").alias("id"), F.col("perceptual_hash").alias("code")), policy.threshold).select("a", "b")
    sha = frame.select("sample_id", "image_sha256")
    near = near.join(sha.toDF("a", "sha_a"), "a").join(sha.toDF("b", "sha_b"), "b").where(~F.col("sha_a").eqNullSafe(F.col("sha_b"))).select("a", "b", F.lit("perceptual").alias("kind"))
    if rejected is not None:
        near = near.join(rejected.select("a", "b"), ["a", "b"], "left_anti")
    token = frame.select("sample_id", F.explode("lineage").alias("token"))
    lineage = all_pairs(token, F.col("token"), "source_lineage")
    return exact.unionByName(near).unionByName(lineage).groupBy("a", "b").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def links(frame: DataFrame, policy: Policy, rejected: DataFrame | None = None) -> DataFrame:
    """(a, b, kind): edges that make the same groups, of the same kinds, as evidence, without a group's pairs. Equal images and lineage tokens are stars; of the
    samples of an image one is held against others' codes, as are those that are in rejected (a, b), which lose their near evidence, or have no image digest."""
    listed = rejected.select(F.explode(F.array("a", "b")).alias("sample_id"), F.lit(True).alias("listed")).distinct() if rejected is not None else None
    own = frame.select("sample_id", F.col("image_sha256").alias("sha"), F.col("perceptual_hash").alias("code")).where("code is not null")
    own = own.withColumn("listed", F.lit(False)) if listed is None else own.join(listed, "sample_id", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    alone = F.when(F.col("listed") | F.col("sha").isNull(), F.col("sample_id"))
    some = written(own.groupBy("code", "sha", alone.alias("alone")).agg(F.min("sample_id").alias("id")), "samples")
    near = near_pairs(some.select("id", "code"), policy.threshold).select("a", "b")
    sha = some.select("id", "sha")
    near = near.join(sha.toDF("a", "sha_a"), "a").join(sha.toDF("b", "sha_b"), "b").where(~F.col("sha_a").eqNullSafe(F.col("sha_b"))).select("a", "b", F.lit("perceptual").alias("kind"))
    if rejected is not None:
        near = near.join(rejected.select("a", "b"), ["a", "b"], "left_anti")
    token = frame.select("sample_id", F.explode("lineage").alias("token"))
    return star(frame, F.col("image_sha256"), "exact").unionByName(near).unionByName(star(token, F.col("token"), "source_lineage"))


def grouped(frame: DataFrame, edges: DataFrame, name: str, prefix: str) -> DataFrame:
    """(sample_id, name): an id made of the members of each component of edges (a, b)."""
    label = components(edges).withColumnRenamed("node", "sample_id")
    ids = label.groupBy("label").agg(S.members_id(prefix, F.collect_list("sample_id")).alias(name))
    return label.join(ids, "label").select("sample_id", name)


def analyze(frame: DataFrame, policy: Policy, decisions: DataFrame | None = None, rejected: DataFrame | None = None) -> DataFrame:
    """frame with duplicate_group_id, duplicate_match_type, deduplication_status, leakage_group_id and the decided include and exclusion_reason.

    Equal images with one label keep the canonical sample (included first, then dataset, evidence, id) and mark the others redundant; with several labels all
    are a conflict and go, unless decisions (image_sha256, canonical_sample_id) names the one to keep. Near and lineage duplicates stay, marked as candidates.
    Samples that any evidence or a common group_id links share a leakage group, named after the group_id where there is only one.
    """
    frame = frame.withColumn("before", F.col("include"))
    pairs = written(links(frame, policy, rejected), "links")
    group = written(grouped(frame, pairs.select("a", "b"), "duplicate_group_id", "DUPLICATE"), "groups")
    kinds = pairs.join(group.withColumnRenamed("sample_id", "a"), "a").groupBy("duplicate_group_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    kinds = kinds.withColumn("duplicate_match_type", F.when(F.size("kinds") == 1, F.element_at("kinds", 1)).otherwise("mixed"))
    edges = pairs.select("a", "b").unionByName(star(frame, F.col("group_id"), "group").select("a", "b"))
    leak = components(edges).withColumnRenamed("node", "sample_id")
    spread = leak.join(frame.select("sample_id", "group_id"), "sample_id").groupBy("label").agg(
        F.count_distinct("group_id").alias("n"), F.min("group_id").alias("only"), S.members_id("LEAKAGE", F.collect_list("sample_id")).alias("made")
    )
    leak = leak.join(spread, "label").select("sample_id", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("made")).alias("leakage"))

    same = frame.where("image_sha256 is not null").groupBy("image_sha256").agg(F.count("*").alias("copies"), F.count_distinct(F.coalesce("disease_id", F.lit("\u0000"))).alias("labels"))
    if decisions is None:
        decisions = frame.limit(0).select("image_sha256", F.col("sample_id").alias("canonical_sample_id"))
    out = frame.join(same.where("copies > 1"), "image_sha256", "left").join(decisions, "image_sha256", "left")
    order = W.partitionBy(F.coalesce("image_sha256", F.concat(F.lit("\u0000"), "sample_id"))).orderBy((~F.col("include")).cast("int"), rank_in([*policy.contributors, *policy.external], F.col("dataset_id")), rank_in(EVIDENCE, F.col("diagnosis_basis")), "sample_id")
    out = out.withColumn("place", F.when(F.col("copies") > 1, F.row_number().over(order)))
    out = out.join(group, "sample_id", "left").join(kinds, "duplicate_group_id", "left").join(leak, "sample_id", "left")
    conflict, reviewed = F.col("labels") > 1, F.col("canonical_sample_id").isNotNull()
    status = (
        F.when(F.col("copies").isNotNull() & conflict & ~reviewed, "exact_label_conflict")
        .when(F.col("copies").isNotNull() & conflict & (F.col("canonical_sample_id") != F.col("sample_id")), "exact_label_conflict")
        .when(F.col("copies").isNotNull() & conflict, "canonical")
        .when(F.col("place") == 1, "canonical")
        .when(F.col("place") > 1, "redundant_exact")
        .when(F.col("duplicate_group_id").isNull(), "unique")
        .when(F.col("duplicate_match_type") == "source_lineage", "source_lineage_candidate")
        .otherwise("perceptual_candidate")
    )
    out = out.withColumn("deduplication_status", status)
    goes = F.col("deduplication_status").isin("exact_label_conflict", "redundant_exact")
    reason = F.when(goes & F.col("include"), F.when(F.col("deduplication_status") == "redundant_exact", "exact_duplicate").otherwise("exact_duplicate_label_conflict")).otherwise(F.col("exclusion_reason"))
    out = out.withColumn("exclusion_reason", reason).withColumn("include", F.col("include") & ~goes).withColumn("leakage_group_id", F.coalesce("leakage", "group_id"))
    added = ["duplicate_group_id", "duplicate_match_type", "deduplication_status", "leakage_group_id"]
    return out.select(*frame.columns, *[c for c in added if c not in frame.columns])


def pair_report(frame: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each pair of evidence, with both samples' attributes."""
    side = lambda x: frame.select(*[F.col(c).alias(f"{c}_{x}") for c in ("sample_id", "dataset_id", "group_id", "disease_id", "perceptual_hash", "include")])
    out = pairs.join(side("a"), F.col("a") == F.col("sample_id_a")).join(side("b"), F.col("b") == F.col("sample_id_b"))
    return out.select(
        F.array_join("kinds", "+").alias("match_evidence"), "sample_id_a", "dataset_id_a", "disease_id_a", "sample_id_b", "dataset_id_b", "disease_id_b",
        hamming(F.col("perceptual_hash_a"), F.col("perceptual_hash_b")).alias("perceptual_hamming_distance"), (F.col("dataset_id_a") != F.col("dataset_id_b")).alias("cross_dataset"),
        (F.col("group_id_a") != F.col("group_id_b")).alias("cross_source_group"), F.col("disease_id_a").eqNullSafe(F.col("disease_id_b")).alias("label_agreement"),
    )


def review_queue(pairs: DataFrame, policy: Policy) -> DataFrame:
    """Pairs with near or lineage evidence, by urgency."""
    inside, outside = [F.col(f"dataset_id_{x}").isin(*policy.contributors) for x in "ab"], [F.col(f"dataset_id_{x}").isin(*policy.external) for x in "ab"]
    labelled = F.col("disease_id_a").isNotNull() & F.col("disease_id_b").isNotNull()
    distance = F.col("perceptual_hamming_distance")
    cases = [
        ("mapped_label_conflict", labelled & ~F.col("label_agreement")),
        ("internal_external_overlap", F.col("cross_dataset") & (inside[0] | inside[1]) & (outside[0] | outside[1])),
        ("cross_dataset_overlap", F.col("cross_dataset")),
        ("perceptual_distance_0", distance == 0),
        ("perceptual_distance_2", distance == 2),
        ("perceptual_distance_4", distance <= 4),
        ("source_lineage_candidate", F.lit(True)),
    ]
    names = [c for c, _ in cases]
    own = pairs.where(F.col("match_evidence").contains("perceptual") | F.col("match_evidence").contains("source_lineage"))
    own = own.withColumn("priority_reason", S.choice(cases, None)).withColumn("review_status", F.lit("pending"))
    return own.withColumn("review_priority", (rank_in(names, F.col("priority_reason")) + 1).cast("int"))


def group_report(frame: DataFrame, group: str = "duplicate_group_id") -> DataFrame:
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    return frame.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count("*").alias("sample_count"), F.count_distinct("dataset_id").alias("dataset_count"), F.count_distinct("group_id").alias("source_group_count"), F.count_distinct("disease_id").alias("label_count"),
        (F.count_distinct("dataset_id") > 1).alias("cross_dataset"), joined("dataset_id").alias("dataset_ids"), joined("sample_id").alias("sample_ids"), joined("disease_id").alias("disease_ids"),
    )


def summary(frame: DataFrame, groups: DataFrame) -> DataFrame:
    """Counts of an analyzed frame for each dataset and, in the row all_datasets, for all."""
    across = groups.where("cross_dataset").select("duplicate_group_id", F.lit(1).alias("across"))
    own = frame.join(across, "duplicate_group_id", "left")
    times = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    has = lambda status: times(F.col("deduplication_status") == status)
    return (
        own.rollup("dataset_id")
        .agg(
            F.grouping("dataset_id").alias("_all"), F.count("*").alias("sample_count"), F.count_distinct("group_id").alias("source_group_count"), F.count_distinct("leakage_group_id").alias("leakage_group_count"),
            F.count("image_sha256").alias("hashed_sample_count"), F.count("duplicate_group_id").alias("duplicate_sample_count"), has("canonical").alias("exact_canonical_count"),
            has("redundant_exact").alias("exact_redundant_count"), has("exact_label_conflict").alias("exact_label_conflict_count"), has("perceptual_candidate").alias("perceptual_candidate_count"),
            has("source_lineage_candidate").alias("source_lineage_candidate_count"), times(F.col("before") & ~F.col("include")).alias("excluded_by_deduplication_count"),
            F.count_distinct("duplicate_group_id").alias("duplicate_group_count"), F.count("across").alias("cross_dataset_duplicate_sample_count"),
        )
        .withColumn("dataset_id", F.when(F.col("_all") == 1, "all_datasets").otherwise(F.col("dataset_id")))
        .drop("_all")
    )


def perceptual_hash(pixels: np.ndarray) -> int:
    """64 bits of a gray picture of 32 x 32: which of its 8 x 8 lowest cosine coefficients exceed the median of those after the first, the first bit highest."""
    n = np.arange(32)
    basis = np.sqrt(2 / 32) * np.cos(np.pi * (2 * n[None] + 1) * n[:, None] / 64)
    basis[0] /= np.sqrt(2)
    low = (basis @ pixels.astype(float) @ basis.T)[:8, :8].reshape(-1)
    return int("".join("1" if b else "0" for b in low > np.median(low[1:])), 2)


def screened(rows: DataFrame, protected: DataFrame, train: DataFrame, threshold: int = 4) -> DataFrame:
    """rows (sample_id, ord, sha, code) with screen: protected_exact, protected_near, train_exact, train_near or kept, the first that holds.

    Train grows by the rows before in order (of equal ord by sample_id) that are kept or train_near: a later row with the image of one is train_exact, one with a near
    code train_near, which is only a flag. Rows near a protected code or equal to a train image don't grow it. protected and train have sha and code; nulls match nothing.
    """
    at = F.struct("ord", "sample_id")
    codes = lambda f: f.where("code is not null").select("code").distinct()
    own, held, base = codes(rows), codes(protected), codes(train)
    every = written(own.unionByName(held).unionByName(base).distinct(), "codes")
    pairs = written(near_pairs(every.select(F.col("code").alias("id"), "code"), threshold).select("a", "b"), "near")
    # near codes of each code, itself among them
    reach = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(every.select(F.col("code").alias("a"), F.col("code").alias("b")))
    of = lambda found, name: reach.join(found.withColumnRenamed("code", "b"), "b").select(F.col("a").alias("code"), F.lit(True).alias(name)).distinct()
    mark = lambda f, name: f.where("sha is not null").select("sha").distinct().withColumn(name, F.lit(True))

    told = rows.join(mark(protected, "pe"), "sha", "left").join(mark(train, "te"), "sha", "left").join(of(held, "pn"), "code", "left")
    told = written(told.select(*rows.columns, "pe", "pn", "te"), "told")
    free = told.where("pe is null and pn is null")
    first = free.where("sha is not null").groupBy("sha").agg(F.min(at).alias("first"))
    # the rows that train grows by, as the first of each code
    grown = free.where("te is null").join(first, "sha", "left").where(F.col("first").isNull() | (F.col("first") == at)).where("code is not null").groupBy("code").agg(F.min(at).alias("at"))
    earliest = reach.join(grown.withColumnRenamed("code", "b"), "b").groupBy("a").agg(F.min("at").alias("earliest")).withColumnRenamed("a", "code")
    out = told.join(first, "sha", "left").join(of(base, "tn"), "code", "left").join(earliest, "code", "left")
    cases = [
        ("protected_exact", F.col("pe").isNotNull()), ("protected_near", F.col("pn").isNotNull()), ("train_exact", F.col("te").isNotNull() | (F.col("first") < at)),
        ("train_near", F.col("tn").isNotNull() | (F.col("earliest") < at)),
    ]
    return out.select(*rows.columns, S.choice(cases, "kept").alias("screen"))
