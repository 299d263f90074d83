"""Columns that travel with a text through Arrow, and batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, unless the session sets its own; a longer row is a batch by itself. Each is held several times: in the JVM, in Python, and as what is made of it.
BATCH = 2 << 20
_SETTING, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64MB", "64m", "67108864")


def unclashed(keep: list[str], *added: str) -> None:
    """An error if a column that is kept has the name of one that is added."""
    if both := sorted({c for c in keep if c.lower() in added}):
        raise ValueError(f"rename {', '.join(both)}: the result has columns of its own called so")


def with_text(docs: DataFrame, keep: list[str], text: str = "text") -> tuple[DataFrame, int, str]:
    """The columns keep of docs and the text as a string, only once where keep has it; its place; the schema of keep."""
    if text in keep:
        rows = docs.select(*[F.col(text).cast("string").alias(text) if c == text else F.col(c) for c in keep])
        kept, place = rows, keep.index(text)
    else:
        kept = docs.select(*keep)
        rows, place = docs.select(*keep, F.col(text).cast("string").alias("_text")), len(keep)
    return rows, place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)


def _give_back() -> None:
    """Freed memory to the system: workers stay for the next stage, and what they hold without need adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_arrow(frame: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """frame.mapInArrow in batches of about BATCH bytes."""
    conf = frame.sparkSession.conf
    if conf.get(_SETTING, _DEFAULT[0]) in _DEFAULT:
        conf.set(_SETTING, str(BATCH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        _give_back()

    return frame.mapInArrow(run, schema)
