"""Threshold-scaled sketches of documents in DataFrame functions: every shingle hash under a fixed share of the hash space is kept; the fingerprints keep all.

Sketches of parts merge by union, and the share of one in another estimates containment whatever the two sizes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cambium.scratch import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, k: int = 5, share: int = 8) -> Column:
    """Ascending distinct 64-bit hashes, under a 1 / share part of the range, of text's shingles of k words; fewer words are one shingle, no word none.

    A word is a run of characters other than space and \\x09-\\x0D, A-Z lower-cased. A short text may have no hash under the bound; its sketch is then empty.
    """
    words = F.filter(F.split(F.translate(text, _UPPER, _LOWER), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def shingles(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0)))
        every = F.transform(places, lambda i: F.when(F.size(h) >= k, F.xxhash64(*[F.get(h, i + j) for j in range(k)])).when(F.size(h) > 0, F.xxhash64(h)))
        return F.sort_array(F.array_distinct(F.filter(every, lambda x: _under(x, share))))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), shingles)


def _under(x: Column, share: int) -> Column:
    """Whether a hash lies under a 1 / share part of the range; with share 1 all do."""
    return x.isNotNull() if share == 1 else x < -(2**63) + 2**64 // share


def hexadecimal(hashes: Column) -> Column:
    """A sketch as text: 16 digits for each hash."""
    return F.array_join(F.transform(hashes, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def common(a: Column, b: Column) -> Column:
    """How many hashes two sketches share."""
    return F.size(F.array_intersect(a, b))


def likeness(a: Column, b: Column, shared: Column | None = None) -> Column:
    """Estimated share of common shingles; two empty sketches are alike. shared: common(a, b), where it is known."""
    n = common(a, b) if shared is None else shared
    union = F.size(a) + F.size(b) - n
    return F.when(union == 0, F.lit(1.0)).otherwise(n / F.nullif(union, F.lit(0)))


def containment(a: Column, b: Column, shared: Column | None = None) -> Column:
    """Estimated share of a's shingles that b has, whatever the two sizes are; null if a's sketch is empty."""
    return (common(a, b) if shared is None else shared) / F.nullif(F.size(a), F.lit(0))


def merged(sketches: Column) -> Column:
    """An aggregate: the sketch, with the same share, of all rows' shingles together."""
    return F.sort_array(F.array_distinct(F.flatten(F.collect_set(sketches))))


#: Ranges of doc_id that documents are dealt into, at most; so many numbers are sent with the plan.
RANGES = 20_000


def _range_of(k: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are k or less, by bisection."""
    own = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>") if bounds else F.array().cast("array<long>")

    def step(a: Column, _: Column) -> Column:
        mid = F.floor((a["low"] + a["high"]) / 2).cast("int")
        return F.when(a["low"] >= a["high"], a).when(F.get(own, mid) <= k, F.struct((mid + 1).alias("low"), a["high"].alias("high"))).otherwise(F.struct(a["low"].alias("low"), mid.alias("high")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")), step, lambda a: a["low"])


def with_next(docs: DataFrame, k: int, share: int) -> DataFrame:
    """(k long, one row each, text) to k, text, sketch, next_text, next_sketch; the next of the last is the first.

    Texts are dealt once, by ranges of k that hold about as many rows each. The first row of each range also goes to the end of the range before it.
    """
    spark = docs.sparkSession
    ranges = min(RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select("k")
    bounds = ids.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    place = _range_of(F.col("k"), sorted(set(bounds)))
    first = [tuple(r) for r in ids.groupBy(place.alias("range")).agg(F.min("k")).orderBy("range").collect()]
    before = spark.createDataFrame([(start, first[i - 1][0], i == 0) for i, (_, start) in enumerate(first)], "k long, range int, wrapped boolean")
    own = docs.withColumn("range", place).withColumn("wrapped", F.lit(False)).withColumn("guest", F.lit(False))
    guests = docs.join(F.broadcast(before), "k").withColumn("guest", F.lit(True))
    dealt = own.unionByName(guests).repartition("range").withColumn("sketch", sketch(F.col("text"), k, share))
    w = W.partitionBy("range").orderBy("wrapped", "k", "guest")
    return dealt.select("k", "text", "sketch", "guest", F.lead("text").over(w).alias("next_text"), F.lead("sketch").over(w).alias("next_sketch")).where("not guest").drop("guest")


def fingerprints(docs: DataFrame, k: int = 5, share: int = 1) -> DataFrame:
    """A row for each row of docs (doc_id long, text string; other columns are ignored): n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, and contained_edited, contained_next, the shares of the text's shingles that the edited text and the next document have (null without a hash).

    The edited text is the text with its last floor(n_chars / 4) characters replaced by the first as many (or all) of the next document, in ascending
    doc_id, after the last the first. Null text is empty. The next document is that with the smallest larger doc_id, of several rows there
    the one with the smallest text; a null doc_id counts as the smallest long. A single document follows itself. With share 1 likenesses are those of the whole
    sets of shingles, for short texts as for long ones; a larger share estimates them, and is far off where a text has few shingles.
    """
    least = F.lit(-(2**63))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    repeated = written(docs.groupBy("k").count().where("count > 1").select("k"), "repeated")
    if not repeated.take(1):
        own = with_next(docs, k, share)
    else:
        same = docs.join(repeated, "k", "left_semi")
        one = written(with_next(docs.join(repeated, "k", "left_anti").unionByName(same.groupBy("k").agg(F.min("text").alias("text"))), k, share), "next")
        of_same = same.withColumn("sketch", sketch(F.col("text"), k, share)).join(one.select("k", "next_text", "next_sketch"), "k")
        own = one.join(repeated, "k", "left_anti").unionByName(of_same)
    n = F.char_length("text")
    own = own.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - F.floor(n / 4).cast("int")), F.substring("next_text", F.lit(1), F.floor(n / 4).cast("int"))))
    own = own.withColumn("edited_sketch", sketch(F.col("edited"), k, share))
    own = own.withColumn("with_edited", common(F.col("sketch"), F.col("edited_sketch"))).withColumn("with_next", common(F.col("sketch"), F.col("next_sketch")))
    pairs = {"edited": (F.col("sketch"), F.col("edited_sketch"), F.col("with_edited")), "next": (F.col("sketch"), F.col("next_sketch"), F.col("with_next"))}
    return own.select(
        F.nullif(F.col("k"), least).alias("doc_id"), n.cast("long").alias("n_chars"), F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        hexadecimal(F.col("sketch")).alias("fingerprint"), hexadecimal(F.col("edited_sketch")).alias("edited_fingerprint"),
        *(likeness(*x).alias(f"near_{n}") for n, x in pairs.items()), *(containment(*x).alias(f"contained_{n}") for n, x in pairs.items()),
    )
