"""Repeated byte strings across documents, by suffix arrays of the places where texts can repeat.

Equal windows have an equal anchor, so only windows whose anchor is met twice can repeat, and those of one anchor can be judged together. Runs of windows that
are equal as a whole are settled by counting. What is left, a small part of the input, goes to suffix arrays made by two-stage sorting: only suffixes
smaller than their successors are sorted directly, the others follow by scanning buckets; adjacent common prefixes then tell which windows repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cambium.llm import words
from cambium.llm.frames import in_arrow
from cambium.scratch import written

#: Bytes of an anchor; windows are of at least 2 * GRAM bytes.
GRAM = 32
#: Bytes of contexts that are sorted at once; an anchor with more contexts than MANY is judged by hashes of its windows instead, which any number of tasks can count.
SORTED, MANY = 1 << 20, 4096
#: Texts, 16 bytes each, that may be broadcast to pick out those to read again.
BROADCAST_TEXTS = 200_000
#: Runs of one context from which it counts as frequent; at least so many that no more contexts than BROADCAST_TEXTS do.
FREQUENT = 10_000
#: Windows whose anchors are sought at once; places among them take PLACE bits of a sort key.
BLOCK, PLACE = 1 << 20, 22
_U = np.uint64


def anchors(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of width bytes that share an anchor: row, first window, bytes from there to the end of the last, anchor, context.

    A window's anchor is its GRAM bytes with the smallest hash, of equal ones the first: equal windows have it at the same place. Windows that follow one
    another mostly share it. The context is a hash of all bytes of a run's windows and the anchor's place there.
    """
    n = len(data)
    if n < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words._BYTE[data] * words.powers(words._BASE, n), out=total[1:])
    inverse = words.powers(words._INVERSE, n + 1)
    gram = total[GRAM:] - total[:-GRAM]
    gram *= inverse[: len(gram)]
    words.mix(gram)
    key = (gram >> _U(PLACE)) << _U(PLACE) | np.arange(len(gram), dtype=np.uint64)
    span, reach = width - GRAM + 1, 1
    while reach * 2 <= span:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if rest := span - reach:
        key = np.minimum(key[: len(key) - rest], key[rest:])
    place = (key & _U((1 << PLACE) - 1)).astype(np.int64)
    # a window that reaches into the next row isn't one
    count = np.maximum(np.diff(at) - width + 1, 0)
    first = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    row = np.repeat(np.arange(len(count)), count)
    own = place[first]
    start = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(row) != 0)])) if len(own) else np.zeros(0, np.int64)
    end = np.concatenate([start[1:], [len(own)]])[: len(start)]
    low, size = first[start], end - start - 1 + width
    context = total[low + size] - total[low]
    context *= inverse[low]
    context += size.astype(np.uint64) * words._LANE[0] + (own[start] - low).astype(np.uint64) * words._LANE[1]
    return row[start], low - at[row[start]], size, gram[own[start]], words.mix(context)


def suffix_order(text: np.ndarray, needed: np.ndarray, depth: int) -> np.ndarray:
    """Places of text that are needed, in the order of their suffixes as far as depth characters at least; those equal so far in any order.

    text is of numbers from 0 to 256, where 0 ends a string and comes before all else. After a needed place whose suffix is larger than the next, that next
    place must be needed too, or hold 0.
    """
    n = len(text)
    after = np.concatenate([text[1:], np.zeros(1, text.dtype)])
    # smaller than its successor: by the next unequal character; a 0 makes what is before it larger
    change = np.flatnonzero(text != after)
    nearest = np.searchsorted(change, np.arange(n))
    rises = np.zeros(n, bool)
    inside = nearest < len(change)
    rises[inside] = text[change[nearest[inside]]] < after[change[nearest[inside]]]
    rises &= text > 0
    small = np.flatnonzero(needed & rises)
    raw, ends = (text - 1).astype(np.uint8).tobytes(), np.flatnonzero(text == 0)
    stop = np.minimum(small + depth, ends[np.searchsorted(ends, small)]) if len(ends) else np.minimum(small + depth, n)
    keys = [raw[a:b] for a, b in zip(small.tolist(), stop.tolist(), strict=True)]
    small = small[sorted(range(len(keys)), key=keys.__getitem__)]
    del keys
    direct = np.searchsorted(text[small], np.arange(258))
    falls = needed & ~rises & (text > 0)
    induced: list[list[np.ndarray]] = [[] for _ in range(257)]

    def scan(places: np.ndarray, bucket: int) -> np.ndarray:
        """What goes before places, to the ends of its buckets; that of the same bucket is returned."""
        before = places[places > 0] - 1
        before = before[falls[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        edge = np.flatnonzero(np.diff(first)) + 1
        same = before[:0]
        for part in np.split(before, edge):
            if len(part):
                if (c := int(text[part[0]])) == bucket:
                    same = part
                else:
                    induced[c].append(part)
        return same

    out = []
    scan(ends, 0)
    for c in range(1, 257):
        wave = np.concatenate(induced[c]) if induced[c] else small[:0]
        while len(wave):
            out.append(wave)
            wave = scan(wave, c)
        own = small[direct[c] : direct[c + 1]]
        if len(own):
            out.append(own)
            scan(own, c)
    return np.concatenate(out) if out else small[:0]


def common(total: np.ndarray, inverse: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix at places a and b, as far as limit; limit characters from either lie in the text. By bisection over running sums."""
    length, step = np.zeros(len(a), np.int64), 1 << (limit.bit_length() - 1)
    while step:
        more = np.minimum(length + step, limit)
        same = (total[a + more] - total[a]) * inverse[a] == (total[b + more] - total[b]) * inverse[b]
        length = np.where(same, more, length)
        step //= 2
    return length


def repeated(contexts: list[bytes], width: int) -> list[tuple[int, int, int]]:
    """Runs of places from where width bytes repeat somewhere in contexts, itself included: context, first place, one after the last."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    data = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    text = data.astype(np.uint16) + 1
    text[begin + sizes] = 0
    window = np.zeros(len(text) + 1, np.int32)
    window[begin] += 1
    window[begin + np.maximum(sizes - width + 1, 0)] -= 1
    window = np.cumsum(window[:-1]) > 0
    # a window's successors as far as one smaller than its own
    rise = np.concatenate([text[:-1] < text[1:], [False]]) & (text > 0)
    last = begin + np.maximum(sizes - width, 0)
    stops = np.flatnonzero(rise | (text == 0))
    reach = stops[np.searchsorted(stops, last)]
    needed = np.zeros(len(text) + 1, np.int32)
    needed[begin] += 1
    needed[np.minimum(reach + 1, begin + sizes)] -= 1
    needed = np.cumsum(needed[:-1]) > 0
    order = suffix_order(text, needed, width)
    order = order[window[order]]
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(words._BYTE[data] * words.powers(words._BASE, len(data)), out=total[1:])
    alike = common(total, words.powers(words._INVERSE, len(total)), order[:-1], order[1:], width) >= width
    again = np.zeros(len(text) + 2, np.int8)
    again[order[:-1][alike] + 1] = 1
    again[order[1:][alike] + 1] = 1
    edge = np.flatnonzero(np.diff(again))
    row = np.searchsorted(begin, edge[::2], "right") - 1
    return list(zip(row.tolist(), (edge[::2] - begin[row]).tolist(), (edge[1::2] - begin[row]).tolist(), strict=True))


# --- on tables. A text is known by two 64-bit hashes of it, t0 and t1, so rows that share a doc_id, or have none, don't matter.


def _anchors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t0, t1 = (batch.column(i).to_numpy() for i in (0, 1))
        for first, data, at in words.chunks(batch.column(2)):
            for start in range(0, max(1, len(data)), BLOCK):  # a longer text's windows go block by block
                own = np.clip(at, start, min(len(data), start + BLOCK + width - 1)) - start if len(data) > 2 * BLOCK else at
                row, low, size, gram, context = anchors(data[start : start + BLOCK + width - 1] if len(data) > 2 * BLOCK else data, own, width)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(t0[row + first]), pa.array(t1[row + first]), pa.array((low + (start if len(data) > 2 * BLOCK else 0)).astype(np.int64)), pa.array(size.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64))],
                        names=["t0", "t1", "low", "size", "anchor", "context"],
                    )
                if len(data) <= 2 * BLOCK:
                    break


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t0, t1, text, asked = (batch.column(i) for i in range(4))
        offsets = asked.offsets.to_numpy()
        inner = asked.values
        low, size, anchor, many = (inner.field(k).to_numpy(zero_copy_only=False) for k in range(4))
        for i in range(batch.num_rows):
            raw, part = text[i].as_buffer().to_pybytes(), slice(offsets[i], offsets[i + 1])
            n = part.stop - part.start
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, t0[i].as_py())), pa.array(np.full(n, t1[i].as_py())), pa.array(low[part]), pa.array(anchor[part]), pa.array(many[part]), pa.array([raw[a : a + b] for a, b in zip(low[part], size[part], strict=True)], pa.binary())],
                names=["t0", "t1", "low", "anchor", "many", "bytes"],
            )


def _spans(rows: list[tuple], found: list[tuple[int, int, int]], width: int) -> pa.RecordBatch:
    columns = zip(*((rows[r][0], rows[r][1], rows[r][2] + a, b - 1 - a + width) for r, a, b in found), strict=True) if found else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["t0", "t1", "low", "size"])


def _sorted(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    rows, held, last = [], 0, None
    for batch in batches:
        for t0, t1, low, anchor, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if held >= SORTED and anchor != last:
                yield _spans(rows, repeated([r[3] for r in rows], width), width)
                rows, held = [], 0
            rows.append((t0, t1, low, raw))
            held, last = held + len(raw), anchor
    if rows:
        yield _spans(rows, repeated([r[3] for r in rows], width), width)


def _windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t0, t1, low, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            n = len(raw) - width + 1
            own = [hashlib.blake2b(raw[i : i + width], digest_size=16).digest() for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t0)), pa.array(np.full(n, t1)), pa.array(np.arange(low, low + n)), pa.array(own, pa.binary())], names=["t0", "t1", "low", "window"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_columns - 2
        out: list[tuple[int, int, int, str, bytes]] = []
        for text, spans in zip(batch.column(n), batch.column(n + 1), strict=True):
            raw = text.as_buffer().to_pybytes()
            edge = np.zeros(len(raw) + 1, np.int32)
            own = spans.values
            low = own.field(0).to_numpy()
            np.add.at(edge, low, 1)
            np.add.at(edge, low + own.field(1).to_numpy(), -1)
            covered = np.cumsum(edge[:-1]) > 0
            rest = np.frombuffer(raw, np.uint8)[~covered].tobytes()
            runs = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum()) if len(raw) else 0
            out.append((len(raw), int(covered.sum()), runs, hashlib.sha256(rest).hexdigest(), rest))
        made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)] if out else []
        if made:
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=[*batch.schema.names[:n], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])


def _few(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if they are few."""
    return F.broadcast(ids) if ids.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS else ids


def without_repeats(docs: DataFrame, keep: list[str], width: int = 200) -> DataFrame:
    """The columns keep of docs, then n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept_bytes (what is left) of each text.

    A byte goes if a string of width bytes that covers it also starts anywhere else, in its own text or another row's; strings are judged on the input. text is
    taken as UTF-8, null as empty: nothing to remove. Rows with equal texts of width bytes or more lose them whole. keep may have any names but those
    added and t0, t1, text, spans, copies. Other columns are ignored; an empty table gives an empty result.

    Texts move twice at most, each time only those that may hold a repeat. Counts over anchors are partial before they are shuffled, and the joins that
    follow can be split where an anchor is in very many texts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(*keep, text.alias("text")).withColumn("t0", F.xxhash64("text")).withColumn("t1", F.xxhash64(F.lit(1), "text"))
    key = ["t0", "t1"]
    long_ = docs.where(F.octet_length("text") >= width)
    copies = written(long_.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    # one row of each group of copies speaks for its text: the windows of the others add nothing but counts, which copies has
    once = long_.join(_few(copies.select(*key)), key, "left_anti").select(*key, "text")
    heads = long_.join(_few(copies.select(*key)), key, "left_semi").groupBy(*key).agg(F.first("text").alias("text"))
    texts = once.unionByName(heads)
    runs = written(in_arrow(texts, lambda batches: _anchors(batches, width), "t0 long, t1 long, low long, size int, anchor long, context long"), "anchors")
    twice = written(runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "twice")
    runs = written(runs.join(twice, "anchor"), "runs")
    contexts = runs.groupBy("anchor", "context").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("t0", "t1", "low", "size")))
    contexts = written(contexts, "contexts")
    # runs of very frequent contexts, which are few, don't meet them in the one task that has a key's rows
    frequent = max(FREQUENT, (contexts.agg(F.sum("n")).first()[0] or 0) // max(1, BROADCAST_TEXTS))
    same = ["anchor", "context"]
    hot = written(contexts.where(F.col("n") > frequent).select(*same), "frequent")
    again = contexts.where(F.col("n").between(2, frequent)).select(*same)
    settled = runs.join(F.broadcast(hot), same, "left_semi").unionByName(runs.join(F.broadcast(hot), same, "left_anti").join(again, same, "left_semi"))
    settled = settled.select(*key, "low", F.col("size").cast("long").alias("size"))
    open_ = contexts.groupBy("anchor").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1")
    open_ = contexts.join(open_, "anchor").select(*key, F.struct("low", "size", "anchor", (F.col("m") > MANY).alias("many")).alias("asked"))
    asked = written(open_.groupBy(*key).agg(F.collect_list("asked").alias("asked")), "asked")
    own = texts.join(_few(asked.select(*key)), key, "left_semi").join(asked, key).select(*key, F.encode("text", "utf-8").alias("text"), "asked")
    cut = written(in_arrow(own, _cut, "t0 long, t1 long, low long, anchor long, many boolean, bytes binary"), "cut")
    few = cut.where("not many").select(*key, "low", "anchor", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    spans = in_arrow(few, lambda batches: _sorted(batches, width), "t0 long, t1 long, low long, size long")
    window = in_arrow(cut.where("many").select(*key, "low", "bytes"), lambda batches: _windows(batches, width), "t0 long, t1 long, low long, window binary")
    window = window.join(window.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window"), "window").select(*key, "low", F.lit(width).cast("long").alias("size"))
    spans = settled.unionByName(spans).unionByName(window).groupBy(*key).agg(F.collect_set(F.struct("low", "size")).alias("spans"))
    spans = written(spans.join(copies.select(*key), key, "left_anti"), "spans")

    known = written(spans.select(*key, F.lit(0).alias("copies")).unionByName(copies.select(*key, F.lit(1).alias("copies"))), "known")
    size = F.octet_length("text").cast("long")
    rest = docs.join(_few(known), key, "left")
    empty = F.encode(F.lit(""), "utf-8")
    whole = F.col("copies") == 1
    plain = rest.where(whole | F.col("copies").isNull()).withColumn("_whole", F.coalesce(whole, F.lit(False))).select(
        *keep, size.alias("n_bytes"), F.when(F.col("_whole"), size).otherwise(F.lit(0)).cast("long").alias("n_removed"), F.col("_whole").cast("long").alias("n_spans"),
        F.sha2(F.when(F.col("_whole"), empty).otherwise(F.encode("text", "utf-8")), 256).alias("kept_sha256"), F.when(F.col("_whole"), empty).otherwise(F.encode("text", "utf-8")).alias("kept_bytes"),
    )
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary"])
    cut_out = in_arrow(rest.where("copies = 0").join(spans, key).select(*keep, F.encode("text", "utf-8").alias("text"), "spans"), _removed, schema)
    return plain.unionByName(cut_out)
