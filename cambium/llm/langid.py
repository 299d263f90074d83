"""Language of texts by compression: the language whose text, as a zstandard dictionary, makes a text smallest."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import exp

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cambium.llm.frames import in_arrow, unclashed, with_text
from cambium.llm.memory import kept
from cambium.scratch import written

_OTHER = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


@dataclass(frozen=True)
class Profile:
    """The bounded sample that is learned from: for each language, of the distinct texts with the least hashes at most texts, the first piece characters of each,
    dictionary bytes in all. Texts are compressed whole, in blocks of block bytes. Of
    equal sizes those at level finer, of each block times over, are taken. A margin, as a share of the second smallest size, under narrow is rejected.
    More languages than languages are an error, as all dictionaries go to all executors."""

    texts: int = 400
    piece: int = 2000
    dictionary: int = 256 << 10
    level: int = 6
    block: int = 2048
    narrow: float = 0.002
    finer: int = 12
    times: int = 4
    languages: int = 400


def letters(text: str) -> bytes:
    """Lower-case words, with one space before, between and after."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} ".encode()


def learn(docs: DataFrame, profile: Profile = Profile()) -> dict[str, bytes]:
    """Dictionary of each lang in docs (text, lang; other columns are ignored). Rows where either is null, or text has no letter, teach nothing; copies count once.

    Rows are picked by hash below a share that fits the language's count of distinct texts, so a frequent language sends no more rows than a rare one.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", F.xxhash64("text").alias("h"), F.substring("text", 1, profile.piece).alias("piece"))
    share = rows.groupBy("lang").agg((2.0 * profile.texts / F.approx_count_distinct("h")).alias("share"))
    share = written(share, "languages")
    if (many := share.count()) > profile.languages:
        raise ValueError(f"{many} languages; dictionaries are made for {profile.languages} at most")
    rows = rows.join(F.broadcast(share), "lang").where((F.col("h") / 2.0**64 + 0.5) < F.col("share")).groupBy("lang", "h").agg(F.min("piece").alias("piece"))
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("n") <= profile.texts)
    out: dict[str, bytes] = {}
    for r in sorted(rows.select("lang", "n", "piece").collect()):
        if len(had := out.get(r["lang"], b"")) < profile.dictionary:
            out[r["lang"]] = (had + letters(r["piece"]))[: profile.dictionary]
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], profile: Profile):
        self.profile = profile
        self.by_lang = {lang: self._compressor(raw, profile.level) for lang, raw in sorted(dictionaries.items())}
        self.finer = {lang: self._compressor(raw, profile.finer) for lang, raw in sorted(dictionaries.items())}

    @staticmethod
    def _compressor(raw: bytes, level: int) -> Callable[[bytes], bytes]:
        own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=level)
        return zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def best(self, text: str | None) -> tuple[str, float, float]:
        """Language, score from 0 to 1, margin. Languages that make a text equally small are held against each other once more, at a stronger level and with each
        block several times over, as zstandard stores what it gains little on as it is; if it is equally small again the margin is 0, the score 0.5, and the name decides."""
        own = letters(text or "")
        if not self.by_lang or not any(c.isalpha() for c in own.decode()):
            return UNKNOWN, 0.0, 0.0
        blocks = [own[i : i + self.profile.block] for i in range(0, len(own), self.profile.block)]
        size = sorted((sum(len(compress(b)) for b in blocks), lang) for lang, compress in self.by_lang.items())
        if len(size) > 1 and size[0][0] == size[1][0]:
            size = sorted((sum(len(self.finer[lang](b * self.profile.times)) for b in blocks), lang) for n, lang in size if n == size[0][0])
        margin = (size[1][0] - size[0][0]) / size[1][0] if len(size) > 1 else 1.0
        return size[0][1], 1 / (1 + exp(-20 * margin)), margin


def _predict(batches: Iterator[pa.RecordBatch], dictionaries: dict[str, bytes], profile: Profile, place: int, n: int) -> Iterator[pa.RecordBatch]:
    own: Classifier = kept(("langid", sorted((k, hash(v)) for k, v in dictionaries.items()), profile), lambda: Classifier(dictionaries, profile))
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            lang, score, margin = zip(*map(own.best, part.column(place).to_pylist()), strict=True)
            rejected = [x == UNKNOWN or m < profile.narrow for x, m in zip(lang, margin, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:n], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*part.schema.names[:n], "lang_pred", "score", "margin", "rejected"],
            )


def classify(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[str], profile: Profile = Profile()) -> DataFrame:
    """The columns keep of docs, then lang_pred, score, margin, rejected. Only text is looked at.

    lang_pred is und, with score 0 and rejected, if text is null or has no letter, or nothing was learned. There is no shuffle. The dictionaries, of
    profile.dictionary bytes at most for each language, are sent to the executors. A column of keep with the name of an added one is an error.
    """
    unclashed(keep, "lang_pred", "score", "margin", "rejected")
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    rows, place, schema = with_text(docs, keep)
    return in_arrow(rows, lambda batches: _predict(batches, sent.value, profile, place, len(keep)), f"{schema}, lang_pred string, score double, margin double, rejected boolean")
