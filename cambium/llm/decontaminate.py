"""Documents that hold benchmark passages, by greedy string tiling.

Windows of shared tokens are the seeds that join a document and a passage; running Karp-Rabin hashes of ever shorter windows then mark the longest common
runs without overlap, so a passage is found though its parts come in another order, and the share of its tokens that are marked decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cambium.llm import words
from cambium.llm.frames import in_arrow, unclashed, with_text
from cambium.llm.memory import kept
from cambium.scratch import written

#: Words of benchmark passages that are sent to the executors at once, as 24 bytes each; a longer benchmark is taken in blocks.
BLOCK = 2_000_000
#: The column that tells rows apart where several blocks are judged.
_NUMBER = "_number"
#: Stands between the stretches of a document that hold seeds; no word has it but by a chance of 2 ** -64.
_BETWEEN = np.uint64(0x7FB5D329728EA185)


@dataclass(frozen=True)
class Tiling:
    """Tiles have least words at least, or a shorter passage's all; coverage is the share of a passage's words in tiles from which a document counts as contaminated."""

    least: int = 5
    coverage: float = 0.5


class _Running:
    """Karp-Rabin hashes of all windows of any length over one sequence of tokens, from one pass of running sums, and which tokens are free."""

    def __init__(self, tokens: np.ndarray, free: np.ndarray):
        self.tokens, self.free = tokens, free
        self.sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * words.powers(words._INVERSE, len(tokens)), out=self.sums[1:])
        self.taken()

    def taken(self) -> None:
        self.marked = np.concatenate([[0], np.cumsum(~self.free)])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all windows of n free tokens, and their hashes."""
        if len(self.tokens) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.marked[n:] == self.marked[:-n])
        return at, words.mix((self.sums[at + n] - self.sums[at]) * words.powers(words._BASE, len(self.sums))[at])

    def mark(self, at: int, n: int) -> None:
        self.free[at : at + n] = False


def _shared(p: _Running, t: _Running, n: int) -> bool:
    return bool(np.isin(p.windows(n)[1], t.windows(n)[1]).any())


def _longest(p: _Running, t: _Running, low: int, high: int) -> int:
    """The largest window length from low to high that both have, by bisection; under low if there is none."""
    if high < low or not _shared(p, t, low):
        return low - 1
    if _shared(p, t, high):
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if _shared(p, t, mid) else (low, mid)
    return low


def tiles(p: np.ndarray, t: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiling as (length, place in p, place in t): the longest common run of unmarked tokens, of equally long ones that first in p, then in t, is marked till none of k tokens is left.

    The search length falls from the longest to k; at each, hashes of the free windows meet, and equal hashes are held against the tokens themselves. Held
    is a few numbers for each token, however often either repeats itself: as tokens of t are only ever taken, each of its windows is passed over once.
    """
    out: list[tuple[int, int, int]] = []
    if min(len(p), len(t)) < k:
        return out
    own = _Running(p, np.ones(len(p), bool))
    # of t only what lies in a window of k tokens that p has too: the seeds
    whole = _Running(t, np.ones(len(t), bool))
    at, seeds = whole.windows(k)
    at = at[np.isin(seeds, own.windows(k)[1])]
    edge = np.zeros(len(t) + 1, np.int32)
    edge[at] += 1
    edge[at + k] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    place = np.flatnonzero(covered | np.concatenate([[False], covered[:-1]]))  # with one token after each stretch, which isn't free
    rest = _Running(t[place], covered[place])
    n = _longest(own, rest, k, min(len(p), len(place)))
    while n >= k:
        where, hashes = rest.windows(n)
        order = np.argsort(hashes, kind="stable")
        where, hashes = where[order], hashes[order]
        starts, wanted = own.windows(n)
        first, last = np.searchsorted(hashes, wanted, "left"), np.searchsorted(hashes, wanted, "right")
        passed: dict[int, int] = {}
        for i, a, b in zip(*(x[first < last].tolist() for x in (starts, first, last)), strict=True):
            if not own.free[i : i + n].all():
                continue
            j = passed.get(a, a)
            while j < b and not (rest.free[where[j]] and rest.free[where[j] + n - 1]):  # tiles at this length are as long: one that meets a window takes an end of it
                j += 1
            passed[a] = j
            while j < b and not (rest.free[where[j] : where[j] + n].all() and (own.tokens[i : i + n] == rest.tokens[where[j] : where[j] + n]).all()):
                j += 1
            if j < b:
                own.mark(i, n)
                rest.mark(int(where[j]), n)
                out.append((n, i, int(place[where[j]])))
        own.taken()
        rest.taken()
        n = _longest(own, rest, k, n - 1)
    return out


class Benchmark:
    """Passages, and the table of their seeds."""

    def __init__(self, rows: list[tuple[int | None, str | None]], tiling: Tiling):
        self.tiling = tiling
        texts = pa.array([r[1] for r in rows], pa.string())
        found = [(w[at[i] : at[i + 1]], r) for first, data, own in words.chunks(texts) for w, at in [words.word_hashes(data, own, words.PLAIN)] for i, r in enumerate(range(first, first + len(at) - 1))]
        self.passages = [(rows[r][0], w) for w, r in found if len(w)]
        self.size = np.array([len(w) for _, w in self.passages], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        #: By length the hashes of all windows in order, and the place of each among the words of all passages.
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.table: dict[int, np.ndarray] = {}
        for k in {min(tiling.least, len(w)) for _, w in self.passages}:
            own = [(words.shingles(w, np.array([0, len(w)]), k)[0], i) for i, (_, w) in enumerate(self.passages) if min(tiling.least, len(w)) == k]
            seed, of = np.concatenate([s for s, _ in own]), np.concatenate([self.begin[i] + np.arange(len(s)) for s, i in own])
            order = np.argsort(seed, kind="stable")
            self.seeds[k] = seed[order], of[order]
            self.table[k] = np.zeros(1 << 22, bool)
            self.table[k][(seed & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def candidates(self, tokens: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[tuple[float, int]]]]:
        """Rows that share a seed with a passage; where in the row shared seeds lie; the passages, with the share of their words that lies in shared seeds, the largest first.

        A row's equal windows count once, so what is held is no more than the benchmark's windows, however often a row repeats one.
        """
        hits = []
        for k, (seed, _) in self.seeds.items():
            windows, at = words.shingles(tokens, rows, k)
            hit = np.flatnonzero(self.table[k][(windows & np.uint64((1 << 22) - 1)).astype(np.int64)])
            hit = hit[seed[np.minimum(np.searchsorted(seed, windows[hit]), len(seed) - 1)] == windows[hit]]
            row = np.searchsorted(at, hit, "right") - 1
            hits.append((k, windows[hit], row, hit - at[row]))
        for r in np.unique(np.concatenate([np.zeros(0, np.int64), *(h[2] for h in hits)])).tolist():
            near = np.zeros(int(rows[r + 1] - rows[r]), bool)
            found = []
            for k, windows, row, place in hits:
                own = slice(*np.searchsorted(row, [r, r + 1]))
                edge = np.zeros(len(near) + 1, np.int32)
                np.add.at(edge, place[own], 1)
                np.add.at(edge, np.minimum(place[own] + k, len(near)), -1)
                near |= np.cumsum(edge[:-1]) > 0
                seed, of = self.seeds[k]
                once = np.unique(windows[own])
                low, high = np.searchsorted(seed, once, "left"), np.searchsorted(seed, once, "right")
                at = np.sort(of[np.repeat(low, high - low) + np.arange((high - low).sum()) - np.repeat(np.cumsum(high - low) - (high - low), high - low)])
                if not len(at):
                    continue
                new = np.minimum(np.append(np.diff(at), k), k)  # words that a window has and the next shared one hasn't
                passage = np.searchsorted(self.begin, at, "right") - 1
                edge = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
                found += zip((np.add.reduceat(new, edge) / self.size[passage[edge]]).tolist(), passage[edge].tolist(), strict=True)
            yield r, near, sorted(found, key=lambda x: (-x[0], x[1]))

    def judge(self, column: pa.Array) -> Iterator[list[tuple[float, int | None, int]]]:
        """For each row coverage, item_id, tiles of the passages it shares a seed with, but for those that are neither the best nor covered enough."""
        for _, data, at in words.chunks(column):
            tokens, rows = words.word_hashes(data, at, words.PLAIN)
            out: list[list] = [[] for _ in range(len(rows) - 1)]
            for row, near, found in self.candidates(tokens, rows):
                keep = np.flatnonzero(near | np.concatenate([[False], near[:-1]]))
                own = np.where(near[keep], tokens[rows[row] : rows[row + 1]][keep], _BETWEEN)
                best = 0.0
                for most, i in found:
                    if most < min(best, self.tiling.coverage):  # it can neither be the best nor count
                        break
                    item, passage = self.passages[i]
                    made = tiles(passage, own, min(self.tiling.least, len(passage)))
                    if made:
                        share = sum(n for n, _, _ in made) / len(passage)
                        best = max(best, share)
                        out[row].append((share, item, len(made)))
            yield from out


def _judged(batches: Iterator[pa.RecordBatch], rows: list, tiling: Tiling, place: int, n: int) -> Iterator[pa.RecordBatch]:
    own: Benchmark = kept(("benchmark", hash(tuple(rows)), tiling), lambda: Benchmark(rows, tiling))
    for batch in batches:
        found = list(own.judge(batch.column(place)))
        best = [max(x, key=lambda c: (c[0], -(c[1] or 0)), default=(0.0, None, 0)) for x in found]
        over = [sum(c[0] >= tiling.coverage for c in x) for x in found]
        columns = [pa.array([b[0] for b in best], pa.float64()), pa.array([b[1] if b[2] else None for b in best], pa.int64()), pa.array([b[2] for b in best], pa.int64()), pa.array(over, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:n], *columns], names=[*batch.schema.names[:n], "coverage", "item_id", "n_tiles", "n_items"])


def judged(docs: DataFrame, benchmark: DataFrame, keep: list[str], tiling: Tiling = Tiling()) -> DataFrame:
    """The columns keep of docs, then coverage (the largest of any passage), item_id and n_tiles of that passage, n_items (passages covered enough), contaminated, kept.

    docs has text, benchmark item_id (long) and text; other columns of the benchmark are ignored. Words are runs without space and ASCII punctuation, A-Z
    lower-cased. Null or empty texts, and an empty benchmark, contaminate nothing: coverage 0, item_id null. Of equal coverages the smallest item_id is told.
    Documents are read whole; the benchmark is sent to the executors in blocks of BLOCK words. Rows out are rows in, also of equal rows. With one block documents
    aren't shuffled; with several they are written once with a number of their own, and joined by it with what the blocks found. A column of keep with the
    name of an added one is an error.
    """
    unclashed(keep, "coverage", "item_id", "n_tiles", "n_items", "contaminated", "kept", _NUMBER)
    sent = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    own, place, schema = with_text(docs, keep)
    found = "coverage double, item_id long, n_tiles long, n_items long"

    def one(rows: list, frame: DataFrame, place: int, n: int, schema: str) -> DataFrame:
        passages = docs.sparkSession.sparkContext.broadcast(rows)
        return in_arrow(frame, lambda batches: _judged(batches, passages.value, tiling, place, n), f"{schema}, {found}")

    parts, block, held = [], [], 0
    numbered = None

    def add() -> None:
        hits = one(block, numbered.select(_NUMBER, numbered.columns[place]), 1, 1, f"`{_NUMBER}` bigint").where("n_tiles > 0")
        parts.append(hits.withColumn("_block", F.lit(len(parts))))

    for row in sent.toLocalIterator():
        if held >= BLOCK:  # and more to come
            if numbered is None:
                numbered = written(own.withColumn(_NUMBER, F.monotonically_increasing_id()), "numbered")
            add()
            block, held = [], 0
        block.append((row["item_id"], row["text"]))
        held += len(row["text"]) // 2 + 1
    if numbered is None:
        out = one(block, own, place, len(keep), schema)
    else:  # several blocks: the best of each row's, of equal ones as one block would tell
        add()
        best = F.max(F.struct("coverage", (-F.coalesce("item_id", F.lit(0))).alias("place"), (-F.col("_block")).alias("block"), "item_id", "n_tiles")).alias("_best")
        met = reduce(DataFrame.unionByName, parts).groupBy(_NUMBER).agg(best, F.sum("n_items").alias("_items"))
        zero = F.lit(0).cast("long")
        out = numbered.join(met, _NUMBER, "left").select(
            *[F.col(c) for c in numbered.columns[: len(keep)]], F.coalesce("_best.coverage", F.lit(0.0)).alias("coverage"), F.col("_best.item_id").alias("item_id"),
            F.coalesce("_best.n_tiles", zero).alias("n_tiles"), F.coalesce("_items", zero).alias("n_items"),
        )
    return out.withColumn("contaminated", F.col("n_items") > 0).withColumn("kept", F.col("n_items") == 0)
