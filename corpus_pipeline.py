"""Stages that make a training corpus of documents. Each is given what its predecessor kept; all but the last return the columns of documents.

Whatever columns documents has travel as one struct, so a name that an operator adds can't clash with theirs. Null and empty texts have no language and go
with the first stage; an empty table stays empty through all stages; of repeated rows of one doc_id one stays after the second.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.llm import bpe, decontaminate, langid, minhash, pii
from cambium.llm.queries import TOKENIZERS, pii_key, table
from cambium.scratch import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: SQL can express none of language identification, tiling, pseudonyms and BPE.
ORACLE_SQL = None


def _whole(docs: DataFrame) -> DataFrame:
    """All columns but the text as one, and the text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"), F.col("text").cast("string").alias("text"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter, or as small by two languages' dictionaries, go. A missing lang is filled in."""
    told = langid.classify(_whole(docs), langid.learn(docs), ["_row", "text"]).where("not rejected")
    lang = F.coalesce(F.col("_row.lang"), F.col("lang_pred")).alias("lang")
    return told.select(*[lang if c == "lang" else F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates: five-word shingles, similarity 0.8."""
    near = minhash.near_duplicates(docs, minhash.Near(k=5))
    gone = written(near.where("not kept").select("doc_id").distinct(), "gone")
    kept = docs.join(F.broadcast(gone) if gone.count() <= minhash.BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not repeated.take(1):
        return kept
    rest = F.struct(*[c for c in docs.columns if c != "doc_id"])  # maps can't be compared, their JSON can
    one = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(rest, F.struct("text", F.to_json(rest))).alias("_row"))
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select("doc_id", "_row.*").select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.judged(_whole(docs), table(spark, sf_dir, "benchmark"), ["_row", "text"]).where("kept").select("_row.*", "text").select(*docs.columns)


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms; n_chars follows the text."""
    made = pii.pseudonymize(_whole(docs), pii_key(spark), ["_row"])
    chars = F.char_length("text").cast("long").alias("n_chars")
    return made.select(*[chars if c == "n_chars" else F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text that they decode to."""
    return bpe.tokenize(docs, f"{TOKENIZERS}/byte_bpe_50k.json", ids=True, remembered=100_000)  # workers outlive the stage, and what they remember with it


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii_pseudonyms", pii_pseudonyms),
    ("bpe_tokens", bpe_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
