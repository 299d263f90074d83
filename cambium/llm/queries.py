"""One query for each operator, over its whole table."""

from __future__ import annotations

import os
import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.llm import bpe, decontaminate, fingerprints, html, langid, lm, minhash, pii, suffixes, unigram


#: Where the vocabulary files of public tokenizers lie.
TOKENIZERS = os.environ.get("CAMBIUM_TOKENIZERS", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Near(k=4))


def fold(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"))
    return langid.classify(docs, langid.learn(docs.where("not held_out")), ["doc_id", "held_out"])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents"), ["doc_id"]).drop("kept_bytes")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.coalesce(fold(5), F.lit(0)) == 1).alias("held_out"))
    return lm.score(docs, "held_out")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


#: The session's setting that has the key, a secret.
PII_KEY = "cambium.pii.key"
_drawn = secrets.token_hex(32)


def pii_key(spark: SparkSession) -> str:
    """The session's key. Where there is none, one drawn for this application: nobody can undo its pseudonyms, and another run's are others."""
    return spark.conf.get(PII_KEY, "") or _drawn


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), pii_key(spark), ["doc_id"])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(table(spark, sf_dir, "documents"), *unigram.vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model"), ["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1,
    "op2_language_id": op2,
    "op3_suffix_array_dedup": op3,
    "op4_lm_scores": op4,
    "op5_fingerprints": op5,
    "op6_pii_pseudonyms": op6,
    "op7_benchmark_decontamination": op7,
    "op8_bpe_encode_decode": op8,
    "op9_html_main_text": op9,
    "op10_token_counts": op10,
}
