"""Scores of texts under an interpolated trigram model whose counts, of all training texts, lie in sharded Elias-Fano tries.

P(w | u v) = (c(u v w) + m P(w | v)) / (c(u v) + m) and P(w | v) = (c(v w) + m P(w)) / (c(v) + m), c being counts in training texts and m the weight of the lower
order (a Dirichlet prior); P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), so an unknown word has a share of its own. A text's first token comes after a sign of its own
and has no longer context, its last is the end.

Documents are read in chunks. Distinct words of chunks are counted and numbered by their shards, the frequent ones first. A chunk then sends each of its distinct
pairs and triples once, as numbers with counts, to the pair's shard, which merges them, makes its trie and answers each chunk; chunks add up their texts' scores.
The triples of a pair that may be in more than a fair share of all tokens are dealt over several shards by their last word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cambium.llm import words
from cambium.llm.frames import in_arrow
from cambium.llm.trie import Trie, probabilities
from cambium.scratch import posix_dir, written

_U = np.uint64
#: Bytes of text in a chunk; a longer text is a chunk by itself.
CHUNK = 4 << 20
#: Tokens a shard has on average, so that shards follow the data.
SHARD = 2_000_000
#: Tokens that the lower order's distribution counts as.
WEIGHT = 50.0
#: Hash of the end of a text.
END = 0x5DEECE66D1234567
_SPREAD = _U(0x9E3779B97F4A7C15)


def _packed(x: np.ndarray, kind: type) -> bytes:
    """Small numbers, which fill few of their bytes: all first bytes, then all second ones and so on. Hashes don't shrink."""
    raw = np.ascontiguousarray(x, kind).view(np.uint8).reshape(len(x), np.dtype(kind).itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def _unpacked(raw: pa.Buffer | bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _rising(x: np.ndarray) -> bytes:
    """Ascending numbers, as the steps between them."""
    return _packed(np.diff(x, prepend=x.dtype.type(0)), x.dtype)


def _risen(raw: pa.Buffer | bytes, kind: type) -> np.ndarray:
    return np.cumsum(_unpacked(raw, kind), dtype=kind)


def _chunk(part: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int, int]], name: int) -> pa.RecordBatch:
    """One row for several runs of documents: hashes of distinct tokens, their first halves, how often each is there and in training; tokens, by their places in the
    order of how often they are there; for each text its row, size and whether it is learned from."""
    hashes, sizes, held = [], [], []
    for batch, data, at, first, n in part:
        own, rows = words.word_hashes(data, at)
        size = np.diff(rows)
        end = rows[1:] + np.arange(n)  # an end after each text's words
        tokens = np.empty(len(own) + n, np.uint64)
        tokens[end] = END
        rest = np.ones(len(tokens), bool)
        rest[end] = False
        tokens[rest] = own
        hashes.append(tokens)
        sizes.append(size + 1)
        held.append(batch.column(1).slice(first, n).to_numpy(zero_copy_only=False).astype(bool))
    distinct, token = np.unique(np.concatenate(hashes), return_inverse=True)
    size, held = np.concatenate(sizes), np.concatenate(held)
    count, uses = np.bincount(token[np.repeat(~held, size)], minlength=len(distinct)), np.bincount(token, minlength=len(distinct))
    rank = np.empty(len(distinct), np.int64)
    rank[np.argsort(-uses, kind="stable")] = np.arange(len(distinct))
    ids = pa.concat_arrays([b.column(0).slice(first, n) for b, _, _, first, n in part])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([name], pa.int64()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([_packed(size, np.int64)], pa.binary()), pa.array([_packed(held, np.uint8)], pa.binary()),
            *(pa.array([x], pa.binary()) for x in (_rising(distinct), _rising((distinct >> _U(32)).astype(np.uint32)), _packed(uses, np.int32), _packed(count, np.int64), _packed(rank[token], np.int32))),
            pa.array([int(size[~held].sum())], pa.int64()), pa.array([int((~held).sum())], pa.int64()), pa.array([len(token)], pa.int64()),
        ],
        names=["chunk", "doc_id", "size", "held", "words", "halves", "uses", "counts", "tokens", "n", "texts", "every"],
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, bytes_, name = [], 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        for first, data, at in words.chunks(batch.column(2)):
            if bytes_ and bytes_ + len(data) > CHUNK:
                yield _chunk(part, name)
                part, bytes_, name = [], 0, name + 1
            part.append((batch, data, at, first, len(at) - 1))
            bytes_ += len(data) + 1
    if part:
        yield _chunk(part, name)


def _column(batch: pa.RecordBatch, name: str, i: int, kind: type) -> np.ndarray:
    return (_risen if name in ("words", "halves") else _unpacked)(batch.column(name)[i].as_buffer(), kind)


def _dealt(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shard, and the places that go there, in order."""
    order = np.argsort(shard.astype(np.uint32 if shards > 65535 else np.uint16), kind="stable")
    edge = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        if edge[s] < edge[s + 1]:
            yield s, order[edge[s] : edge[s + 1]]


def _word_requests(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            chunk, distinct, count = batch.column("chunk")[i].as_py(), _column(batch, "words", i, np.uint64), _column(batch, "counts", i, np.int64)
            rows = [(chunk, s, _rising(distinct[at]), _packed(count[at], np.int64)) for s, at in _dealt((distinct >> _U(32)).astype(np.int64) % shards, shards)]
            if rows:
                yield _reply(rows, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), ["chunk", "shard", "words", "counts"])


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of one shard after another; they come sorted by shard."""
    rows: list[tuple] = []
    for batch in batches:
        for i in range(batch.num_rows):
            row = tuple(c[i].as_py() if not pa.types.is_binary(c.type) else c[i].as_buffer() for c in batch.columns)
            if rows and rows[0][1] != row[1]:
                yield rows[0][1], rows
                rows = []
            rows.append(row)
    if rows:
        yield rows[0][1], rows


def _reply(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _word_shards(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """For each chunk its words' counts and numbers, from 1, the smallest for frequent words; for the shard, in a row without a chunk, how many words it has."""
    names, kinds = ["chunk", "shard", "counts", "numbers", "distinct"], (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
    for shard, rows in _by_shard(batches):
        asked = [_risen(r[2], np.uint64) for r in rows]
        distinct, place = np.unique(np.concatenate(asked), return_inverse=True)
        count = np.zeros(len(distinct), np.int64)
        np.add.at(count, place, np.concatenate([_unpacked(r[3], np.int64) for r in rows]))
        number = np.empty(len(distinct), np.int64)
        number[np.argsort(-count, kind="stable")] = np.arange(len(distinct)) * shards + shard + 1
        at, out = 0, [(None, shard, None, None, int((count > 0).sum()))]
        for r, a in zip(rows, asked, strict=True):
            own = place[at : at + len(a)]
            out.append((r[0], shard, _packed(count[own], np.int64), _packed(number[own], np.int64), None))
            at += len(own)
        yield _reply(out, kinds, names)


class Dealer:
    """The distinct pairs and triples of a chunk, and the shard of each. Words go by their place in the order of their numbers; place 0 is the sign before a text."""

    def __init__(self, batch: pa.RecordBatch, i: int, shards: int, fair: float, texts: int):
        halves, uses, ranked = _column(batch, "halves", i, np.uint32), _column(batch, "uses", i, np.int32), _column(batch, "tokens", i, np.int32)
        token = np.argsort(-uses, kind="stable")[ranked]
        self.size, self.held, self.shards = _column(batch, "size", i, np.int64), _column(batch, "held", i, np.uint8).astype(bool), shards
        count, number = np.zeros(len(halves), np.int64), np.zeros(len(halves), np.int64)
        answers = {a["shard"]: a for a in batch.column("of_words")[i].as_py()}
        for s, at in _dealt(halves.astype(np.int64) % shards, shards):
            count[at], number[at] = _unpacked(answers[s]["counts"], np.int64), _unpacked(answers[s]["numbers"], np.int64)
        order = np.argsort(number)
        place = np.empty(len(halves), np.int64)
        place[order] = np.arange(1, len(halves) + 1)
        self.number, self.count = np.append(0, number[order]).astype(np.uint64), np.append(texts, count[order])
        self.token, n = place[token], len(self.number)
        self.begin = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        first = np.zeros(len(token), bool)
        first[self.begin] = True
        before = np.append(0, self.token[:-1])[: len(token)]
        before[first] = 0
        self.pairs, self.pair = np.unique(before * n + self.token, return_inverse=True)
        self.u, self.v = np.divmod(self.pairs, n)
        self.later = np.flatnonzero(~first)  # tokens that have two before them, the sign included
        triples, self.triple = np.unique(self.pair[self.later - 1] * n + self.token[self.later], return_inverse=True)
        self.context, self.w = np.divmod(triples, n)
        self.train = np.repeat(~self.held, self.size)
        # neither word is in more tokens than the pair, so both are looked at to see whether it may be too frequent for one shard
        spread = (np.minimum(self.count[self.u], self.count[self.v]) / fair).astype(np.uint64) + _U(1)
        key = words.mix(self.number[self.u] * _SPREAD + self.number[self.v])
        salt = words.mix(self.number[self.w] + _U(1)) % spread[self.context]
        self.pair_shard = (key % _U(shards)).astype(np.int64)
        self.triple_shard = np.where(salt > 0, words.mix(key[self.context] + salt * _SPREAD) % _U(shards), key[self.context] % _U(shards)).astype(np.int64)

    def parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Shard; pairs that are asked there, or whose triples are; which of them are; triples, in order of their pairs."""
        by_pair, by_triple = dict(_dealt(self.pair_shard, self.shards)), dict(_dealt(self.triple_shard, self.shards))
        none = np.zeros(0, np.int64)
        for s in sorted(by_pair.keys() | by_triple.keys()):
            own, triples = by_pair.get(s, none), by_triple.get(s, none)
            every = np.union1d(own, self.context[triples])
            yield s, every, np.isin(every, own, assume_unique=True), triples


def _numbers(x: np.ndarray) -> tuple[bytes, int]:
    size = 4 if not len(x) or int(x.max()) < 1 << 32 else 8
    return _packed(x, np.uint32 if size == 4 else np.uint64), size


def _pair_requests(batches: Iterator[pa.RecordBatch], shards: int, fair: float, texts: int) -> Iterator[pa.RecordBatch]:
    """Pairs as steps from first word to first word, and second words; their counts and 1, or 0 where only triples are asked; how many triples each has; third words, counts."""
    names = ["chunk", "shard", "bytes", "first", "second", "times", "sizes", "third", "counts"]
    kinds = (pa.int64(), pa.int32(), pa.int32(), *(pa.binary(),) * 6)
    for batch in batches:
        for i in range(batch.num_rows):
            own = Dealer(batch, i, shards, fair, texts)
            times = np.bincount(own.pair[own.train], minlength=len(own.pairs))
            counts = np.bincount(own.triple[own.train[own.later]], minlength=len(own.w))
            rows = []
            for s, pairs, asked, triples in own.parts():
                u = own.number[own.u[pairs]]
                sizes = np.bincount(np.searchsorted(pairs, own.context[triples]), minlength=len(pairs))
                (first, a), (second, b), (third, c) = _numbers(np.diff(u, prepend=_U(0))), _numbers(own.number[own.v[pairs]]), _numbers(own.number[own.w[triples]])
                rows.append((batch.column("chunk")[i].as_py(), s, a | b << 8 | c << 16, first, second, _packed(np.where(asked, times[pairs] + 1, 0), np.int32), _packed(sizes, np.int32), third, _packed(counts[triples], np.int32)))
                if len(rows) == 64:
                    yield _reply(rows, kinds, names)
                    rows = []
            if rows:
                yield _reply(rows, kinds, names)


class Asked:
    """One chunk's question to a shard."""

    def __init__(self, row: tuple):
        self.chunk = row[0]
        kind = lambda shift: np.uint32 if row[2] >> shift & 255 == 4 else np.uint64
        self.u = np.cumsum(_unpacked(row[3], kind(0)).astype(np.uint64), dtype=np.uint64)
        self.v, self.w = _unpacked(row[4], kind(8)).astype(np.uint64), _unpacked(row[7], kind(16)).astype(np.uint64)
        times = _unpacked(row[5], np.int32)
        self.asked, self.times = times > 0, np.maximum(times - 1, 0)
        self.sizes, self.counts = _unpacked(row[6], np.int32), _unpacked(row[8], np.int32)


def _keyed(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of couples of numbers where the distinct ones are, in ascending order, and which of those each is. Chunks' runs come sorted, which a merging sort makes use of."""
    if not len(high):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if max(int(high.max()), int(low.max())) < 1 << 32:
        order = np.argsort(high.astype(np.uint64) << _U(32) | low, kind="stable")
    else:
        order = np.lexsort((low, high))
    new = np.concatenate([[True], (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])])
    which = np.empty(len(high), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


class Merged:
    """All that chunks ask a shard and tell it: distinct pairs, distinct triples in order of their pairs, counts; which of them each chunk's are."""

    def __init__(self, asked: list[Asked]):
        u, v, times, sizes = (np.concatenate([getattr(a, x) for a in asked]) for x in ("u", "v", "times", "sizes"))
        w, counts = np.concatenate([a.w for a in asked]), np.concatenate([a.counts for a in asked])
        first, self.pair = _keyed(u, v)
        self.u, self.v = u[first], v[first]
        self.times = np.bincount(self.pair, times, minlength=len(first)).astype(np.int64)
        of = np.repeat(self.pair, sizes)
        first, self.triple = _keyed(of, w)
        self.of, self.w = of[first], w[first]
        self.counts = np.bincount(self.triple, counts, minlength=len(first)).astype(np.int64)

    def sizes(self, some: np.ndarray) -> np.ndarray:
        return np.bincount(self.of[some], minlength=len(self.u))

    def trie(self, total: int) -> Trie:
        """Of the pairs and triples that training texts have."""
        seen = self.counts > 0
        sizes = self.sizes(seen)
        known = (self.times > 0) | (sizes > 0)
        return Trie.build(self.u[known], self.v[known], self.times[known], sizes[known], self.w[seen], self.counts[seen], total)


def _pair_shards(batches: Iterator[pa.RecordBatch], total: int, folder: str | None) -> Iterator[pa.RecordBatch]:
    """For each chunk the codes of its pairs and triples. What several chunks ask is sought once."""
    for shard, rows in _by_shard(batches):
        asked = [Asked(r) for r in rows]
        merged = Merged(asked)
        pairs, triples = merged.trie(total).mapped(folder).query(merged.u, merged.v, merged.sizes(np.ones(len(merged.of), bool)), merged.w)
        i = j = 0
        for a in asked:
            own, after = merged.pair[i : i + len(a.u)], merged.triple[j : j + len(a.w)]
            i, j = i + len(a.u), j + len(a.w)
            yield _reply([(a.chunk, shard, _packed(pairs[own[a.asked]], np.uint16), _packed(triples[after], np.uint16))], (pa.int64(), pa.int32(), pa.binary(), pa.binary()), ["chunk", "shard", "pairs", "triples"])


def _scores(batches: Iterator[pa.RecordBatch], shards: int, fair: float, texts: int, total: int, distinct: int, weight: float) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    for batch in batches:
        for i in range(batch.num_rows):
            own = Dealer(batch, i, shards, fair, texts)
            base = (own.count + 0.5) / (total + 0.5 * (distinct + 1))
            pair, triple = np.zeros(len(own.pairs), np.uint16), np.zeros(len(own.w), np.uint16)
            answers = {a["shard"]: a for a in batch.column("of_pairs")[i].as_py()}
            for s, pairs, asked, triples in own.parts():
                pair[pairs[asked]], triple[triples] = _unpacked(answers[s]["pairs"], np.uint16), _unpacked(answers[s]["triples"], np.uint16)
            times, counts = (np.rint(probabilities(x) * total) for x in (pair, triple))  # exact up to some thousands
            second = (times + weight * base[own.v]) / (own.count[own.u] + weight)
            p = second[own.pair]
            third = (counts[own.triple] + weight * p[own.later]) / (times[own.context][own.triple] + weight)
            p[own.later] = third
            add = lambda x: np.add.reduceat(x, own.begin) if len(own.begin) else x[:0]  # noqa: B023, E731
            columns = [own.held, own.size, add((own.count[own.token] > 0).astype(np.int64)), np.full(len(own.size), total, np.int64), add(np.log10(base[own.token])), add(np.log10(p))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i].values, *map(pa.array, columns)], names=names)


def score(docs: DataFrame, held_out: str, weight: float = WEIGHT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id long, text string and a boolean column named by held_out; others are ignored).

    Rows where held_out is false are learned from, each as often as it is there; null counts as true. Null text is empty: its one token is the end. base_score and score
    are log10 probabilities of the whole text under P(w) and under the model. With nothing to learn from all words are unknown, with probability 1. An empty
    table gives an empty result; a null doc_id stays null.

    Nothing is pruned, so what is counted and shuffled grows with the input, and so do the shards. No task gets more than some shards of about SHARD tokens, a
    chunk, or one text. Words are told apart by 64-bit hashes, then by numbers; nothing is collected but three sums.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(held_out), F.lit(True)).alias("held"), F.col("text").cast("string").alias("text"))
    schema = "chunk long, doc_id array<long>, size binary, held binary, words binary, halves binary, uses binary, counts binary, tokens binary, n long, texts long, every long"
    chunks = written(in_arrow(rows, _chunks, schema), "chunks")
    total, texts, every = chunks.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "texts", "every"))).first()
    shards = max(1, -(-every // SHARD))
    fair = SHARD / 4

    asked = in_arrow(chunks.select("chunk", "words", "counts"), lambda b: _word_requests(b, shards), "chunk long, shard int, words binary, counts binary")
    of_words = asked.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "chunk")
    of_words = written(in_arrow(of_words, lambda b: _word_shards(b, shards), "chunk long, shard int, counts binary, numbers binary, distinct long"), "words")
    distinct = of_words.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]

    def by(answers: DataFrame, name: str, *columns: str) -> DataFrame:
        return answers.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("shard", *columns)).alias(name))

    parts = chunks.select("chunk", "doc_id", "size", "held", "halves", "uses", "tokens").join(by(of_words, "of_words", "counts", "numbers"), "chunk")
    asked = in_arrow(parts, lambda b: _pair_requests(b, shards, fair, texts), "chunk long, shard int, bytes int, first binary, second binary, times binary, sizes binary, third binary, counts binary")
    folder = posix_dir(spark, "tries")
    of_pairs = asked.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "chunk")
    of_pairs = written(in_arrow(of_pairs, lambda b: _pair_shards(b, total, folder), "chunk long, shard int, pairs binary, triples binary"), "pairs")

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return in_arrow(parts.join(by(of_pairs, "of_pairs", "pairs", "triples"), "chunk"), lambda b: _scores(b, shards, fair, texts, total, distinct, weight), schema)
