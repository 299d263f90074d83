"""Near-duplicate documents by b-bit MinHash.

Bands of full minima name candidates; of each minimum only the low bits are retained, packed, and a count of equal lanes, corrected for lanes
that agree by chance, estimates similarity; what remains is confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cambium.llm import words
from cambium.llm.frames import in_arrow
from cambium.llm.memory import release
from cambium.operators.graph import components
from cambium.scratch import written

#: Ids of documents that may be broadcast to fetch their texts: 8 bytes each. More are fetched by a shuffled join.
BROADCAST_IDS = 200_000
#: Members of a bucket that are compared with as many others at once, where the bucket's head left pairs open: what a task needs doesn't grow with the bucket.
BLOCK = 512


@dataclass(frozen=True)
class Near:
    """k words a shingle; similarity in hundredths; bands of rows minima each; low bits kept of each minimum (a power of two).

    With 32 bands of 4, a pair at similarity 0.8 shares no band once in 20 million; the estimate of such a pair, of 128 lanes of 4 bits, falls under
    doubt = 0.55 once in 100 billion. Where a bucket's head leaves pairs open, fine_lanes lanes of fine_bits bits estimate them more closely: under
    fine_doubt = 0.72 once in 30 million.
    """

    k: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    bits: int = 4
    doubt: float = 0.55
    fine_lanes: int = 1024
    fine_bits: int = 2
    fine_doubt: float = 0.72

    @property
    def lanes(self) -> int:
        return self.bands * self.rows


def hashers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of n hash functions."""
    rng = np.random.Generator(np.random.PCG64(7919 + n))
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of each of len(a) hash functions over a set that isn't empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (a[:, None] * x[None, i : i + 1024] + b[:, None]).min(axis=1), out=out)
    return out


def packed(low: np.ndarray, bits: int) -> np.ndarray:
    """Low bits of each row's minima, packed into longs."""
    lanes = 64 // bits
    x = (low & np.uint32((1 << bits) - 1)).astype(np.uint64).reshape(len(low), -1, lanes)
    return (x << (np.arange(lanes, dtype=np.uint64) * np.uint64(bits))).sum(axis=2, dtype=np.uint64).view(np.int64)


def sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes, ascending."""
    for _, data, at in words.chunks(column):
        own, rows = words.shingles(*words.word_hashes(data, at), k)
        for i in range(len(rows) - 1):
            yield np.unique(own[rows[i] : rows[i + 1]])


def _signatures(batches: Iterator[pa.RecordBatch], near: Near) -> Iterator[pa.RecordBatch]:
    release()
    a, b = hashers(near.lanes)
    for batch in batches:
        n = batch.num_rows
        count, digest, least = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64), np.zeros((n, near.lanes), np.uint32)
        for i, own in enumerate(sets(batch.column(1), near.k)):
            if count_i := len(own):
                count[i] = count_i
                x = xxhash.xxh3_128_intdigest(own.tobytes())
                digest[i] = x & 0xFFFFFFFFFFFFFFFF, x >> 64
                least[i] = minima(own, a, b)
        keys = np.zeros((n, near.bands), np.uint64)
        for j in range(near.rows):
            keys = words.mix(keys + least[:, j :: near.rows].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        keys = words.mix(keys + np.arange(near.bands, dtype=np.uint64))
        sig = packed(least, near.bits)
        wide = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(count), *(pa.array(digest[:, j].copy().view(np.int64)) for j in (0, 1)), wide(keys.view(np.int64)), *(pa.array(np.ascontiguousarray(sig[:, j])) for j in range(sig.shape[1]))],
            names=["doc_id", "n_shingles", "d0", "d1", "bands", *(f"s{j}" for j in range(sig.shape[1]))],
        )


def names(lanes: int, bits: int) -> list[str]:
    """Columns of a packed signature."""
    return [f"s{j}" for j in range(lanes * bits // 64)]


def likeness(lanes: int, bits: int, left: str, right: str) -> Column:
    """Similarity from the count of equal lanes: two unequal minima agree in their low bits once in 2 ** bits, which is taken off."""
    unequal = F.lit(0)
    low = int("".join(["1".rjust(bits, "0")] * (64 // bits)), 2)
    for s in names(lanes, bits):
        x = F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))
        step = bits // 2
        while step:
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
            step //= 2
        unequal = unequal + F.bit_count(x.bitwiseAND(F.lit(low)))
    chance = 2.0**-bits
    return (1 - unequal / lanes - chance) / (1 - chance)


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, x, y = (batch.column(i) for i in range(4))
        keep = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            u, v = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (x, y))
            if 100 * min(len(u), len(v)) >= percent * max(len(u), len(v)):
                both = np.concatenate([u, v])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * same >= percent * (len(both) - same)
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep))


def few(ids: DataFrame) -> DataFrame:
    """ids of 8 bytes, to be broadcast if they are few."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """node, shingles of the documents with these doc_ids, as a written table."""
    own = docs.where(F.col("doc_id").isNotNull()).join(few(ids.distinct()), "doc_id", "left_semi")
    return written(in_arrow(own, lambda batches: _sets(batches, k), "node long, shingles binary"), "sets")


def confirmed(pairs: DataFrame, full: DataFrame, near: Near) -> DataFrame:
    """Of the pairs (a, b) those whose full shingle sets are alike enough."""
    one, two = (full.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")) for x in ("a", "b"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b")
    return in_arrow(joined, lambda batches: _confirmed(batches, near.percent), "a long, b long")


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets(batch.column(1), k)], pa.binary())], names=["node", "shingles"])


def _fine(batches: Iterator[pa.RecordBatch], lanes: int, bits: int) -> Iterator[pa.RecordBatch]:
    a, b = hashers(lanes)
    for batch in batches:
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
        sig = packed(np.array([minima(x, a, b) for x in own], np.uint32).reshape(len(own), lanes), bits)
        columns = [batch.column(0), pa.array([len(x) for x in own], pa.int64()), *(pa.array(np.ascontiguousarray(sig[:, j])) for j in range(sig.shape[1]))]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "n_shingles", *names(lanes, bits)])


def near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id long, text string; other columns are ignored).

    Documents whose sets of k-word shingles have similarity percent / 100 at least are linked; component_id is the smallest doc_id that can be
    reached, kept says that it is the document's own. Fewer than k words are one shingle; a null or blank text has none, is linked with nothing
    and is kept. Rows that share a doc_id count as one document. A null doc_id is linked with nothing: component_id is null and kept is true.

    Equal sets are merged first, so copies cost one signature row each and no pairs. In each bucket of a band, every member is compared with the
    smallest one; only members that are then still in different components are compared with each other, in blocks and in the first band that they share, so a large group of
    near copies costs as many pairs as it has members and no link between different components is left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig_columns, fine_columns = names(near.lanes, near.bits), names(near.fine_lanes, near.fine_bits)
    schema = "doc_id long, n_shingles long, d0 long, d1 long, bands array<long>, " + ", ".join(f"{s} long" for s in sig_columns)
    signed = written(in_arrow(docs, lambda batches: _signatures(batches, near), schema), "signatures")
    own = signed.where("n_shingles > 0 and doc_id is not null")
    # sums by key are tables of their own before rows are joined to them: a join that reads them from their shuffle can't be split where a key has very many rows
    classes = written(own.groupBy("d0", "d1").agg(F.min("doc_id").alias("node")), "classes")
    member = written(own.select("doc_id", "n_shingles", "d0", "d1").join(classes, ["d0", "d1"]), "members")
    heads = member.where("doc_id = node").select("node", "d0", "d1").distinct()
    head = written(own.join(heads, (own["doc_id"] == heads["node"]) & (own["d0"] == heads["d0"]) & (own["d1"] == heads["d1"]), "left_semi").withColumnRenamed("doc_id", "node").drop("d0", "d1"), "heads")

    placed = head.select("node", F.posexplode("bands").alias("band", "key"))
    bucket = placed.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("size")).where("first <> last")
    bucket = written(bucket, "bucket")
    placed = written(placed.join(bucket.select("key", "first", "size"), "key"), "buckets")

    sized = 100 * F.least("x.n_shingles", "y.n_shingles") >= near.percent * F.greatest("x.n_shingles", "y.n_shingles")
    side = head.select("node", "n_shingles", *sig_columns)
    star = placed.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    star = star.join(side.alias("x"), F.col("a") == F.col("x.node")).join(side.alias("y"), F.col("b") == F.col("y.node"))
    star = written(star.where((likeness(near.lanes, near.bits, "x", "y") >= near.doubt) & sized).select("a", "b"), "star")
    full = full_sets(docs, star.select(F.explode(F.array("a", "b")).alias("doc_id")), near.k)
    linked = written(confirmed(star, full, near), "linked")
    label = components(linked)

    open_ = placed.where("size > 2").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = written(open_, "open")
    mixed = written(open_.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key"), "mixed")
    open_ = written(open_.join(few(mixed), "key", "left_semi").where("node <> first"), "open")
    if open_.take(1):
        full = full_sets(docs, open_.select(F.col("node").alias("doc_id")), near.k)
        fine = in_arrow(full, lambda batches: _fine(batches, near.fine_lanes, near.fine_bits), "node long, n_shingles long, " + ", ".join(f"{s} long" for s in fine_columns))
        open_ = open_.join(fine, "node").join(head.select("node", "bands"), "node")
        open_ = written(open_.withColumn("before", F.slice("bands", F.lit(1), F.col("band"))).drop("bands"), "open")
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work: not to be coalesced by size
        own, other = F.pmod(F.xxhash64("node"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
        x = open_.withColumn("block", own).withColumn("with", other).repartition(parts, "key", "block", "with").alias("x")
        y = open_.withColumn("with", own).withColumn("block", other).repartition(parts, "key", "block", "with").alias("y")
        cross = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.with") == F.col("y.with")) & (F.col("x.label") < F.col("y.label")) & sized & (likeness(near.fine_lanes, near.fine_bits, "x", "y") >= near.fine_doubt) & ~F.arrays_overlap("x.before", "y.before"))
        cross = written(cross.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "cross")
        more = written(confirmed(cross, full, near), "linked")
        if more.take(1):
            label = components(linked.union(more))

    placed_in = member.select("doc_id", "node").distinct().join(label, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "node")).alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(placed_in, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
